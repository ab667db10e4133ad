"""Surrogates for personal data, with DataFrame functions only.

Entities (e-mail and IP addresses, phone, card and account numbers, keys, passwords, titled names) are found by
patterns; a number in the form of a card counts only with a right check digit. Documents with none pass untouched and take
no part in any shuffle. Each distinct entity gets a surrogate from a keyed hash (HMAC with SHA-256): same kind, same length and same
classes of character at every place (digits stay digits, capitals capitals, letters keep their script and accent class,
separators stay; in names vowels stay vowels). The key is the session's, or is drawn once and kept. Mail addresses end in a reserved domain; cards keep their first digit, accounts their country, phone
numbers their country code and keys their prefix, and check digits are right; names keep title (and so gender) and
script. Given name and surname are entities apart and mail addresses count in lower case, so all forms of a reference keep together
in all documents; names of a document are also replaced where they stand without a title (n_entities counts patterns only).
A given name of a short list gets an ending of its gender.
A check then looks for surrogates that two entities share or that equal a real entity of the corpus; the losers (all but
the entity that sorts first) are derived anew with the next round number until none is left, so entities stay distinct; after GROW
rounds they grow. Letters of other scripts become Latin ones of their case; an entity of punctuation alone becomes letters.

Defined results: null and empty texts come back as they are with 0 entities; repeated rows get equal results; a null
doc_id keeps its row; entities overlap never, the leftmost and then first pattern wins; other columns are not read.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.llm.common import join_hot, scratch, stored
from heatfield.sources import files

#: The session's setting that holds the key.
KEY_SETTING = "heatfield.surrogate.key"
#: After so many rounds a surrogate gets a digit more with each round, so that there is always a free one.
GROW = 3
#: Kind and pattern, in order of precedence.
PATTERNS = {
    # It begins where a run of its characters does or the last match ended, so that a long run is read once; a domain has 127 labels at most.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+){0,126}\.[A-Za-z]{2,}",
    "secret": r"(?i:\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Z0-9]{36}\b|(?<=password=)[^\s\"']+|(?<=\")[0-9a-f]{40}(?=\"))",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "card": r"(?<!\d)(?:\d{4}[ -]?){3}\d{3,4}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": r"(?<![\d\w])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\d\w])\+\d{8,15}(?![\d\w])|(?<![\d\w])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\) ?\d{5,9}(?![\d\w])|(?<![\d\w])\+\d{1,3}[ .-]\d{2,5}[ .-]\d{4,9}(?![\d\w])|(?<![\d\w])0\d{2,4}[ /-]\d{5,9}(?![\d\w])",
    "name": r"(?<=\b(?:Mr|Ms|Dr)\. |\bMrs\. |\bHerr |\bFrau |\bM\. |\bMme |\bSr\. |\bSra\. )\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Text without a digit, an @ or one of these has no entity; that is cheap to see, and few texts need the patterns.
SIGNS = ("Mr. ", "Ms. ", "Dr. ", "Mrs. ", "Herr ", "Frau ", "M. ", "Mme ", "Sr. ", "Sra. ")
#: Customary given names, whose surrogates get an ending of the same gender.
FEMALE = "anna maria marie eva lena laura julia sarah emma sophie sofia lisa claire camille chloé léa carmen lucía elena ana marta isabel mary jane alice emily susan karen linda petra sabine monika ursula helga inge élodie juliette nathalie"
MALE = "john james peter paul max hans karl thomas michael david robert william george jean pierre luc jacques louis antoine carlos juan josé luis miguel pedro pablo diego jürgen klaus stefan andreas martin felix lukas jonas"
DIGITS, LOW, CAP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: In names a vowel stays a vowel and a consonant a consonant, so they can be spoken.
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Other scripts keep their script: small and capital letters of the same block.
SCRIPTS = [("àâäáãåçèéêëìíîïñòóôöõùúûüýß", "àâäáãåçèéêëìíîïñòóôöõùúûüýß"), ("ÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ", "ÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ"), ("αβγδεζηθικλμνξοπρστυφχψω", "αβγδεζηθικλμνξοπρστυφχψω"), ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "абвгдежзийклмнопрстуфхцчшщъыьэюя"), ("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")]


def session_key(spark: SparkSession) -> str:
    """The configured key, or else one that is drawn once and kept beside the session's checkpoints, so that nobody else can make the same surrogates and later runs do."""
    if key := spark.conf.get(KEY_SETTING, None):
        return key
    path = f"{scratch(spark, 'key').rpartition('/')[0]}/surrogate-key"
    files.create(spark, path, secrets.token_hex(32))
    return files.read(spark, path)


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, p in reversed(PATTERNS.items()):
        p = {"secret": r"(?i:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Z0-9]{36}|[0-9a-f]{40})", "name": r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?"}.get(kind, p)
        out = F.when(entity.rlike(rf"^(?:{p})$"), F.lit(kind)).otherwise(out)
    return F.coalesce(out, F.lit("secret"))


def hmac(text: Column, key: str) -> Column:
    """HMAC with SHA-256 as lower-case hex."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "utf-8")), 256))), 256)


def luhn(digits: Column) -> Column:
    """The sum of a card number's check, modulo 10; 0 is right. Other characters than digits count for nothing."""
    plain = F.split(F.reverse(F.regexp_replace(digits, "[^0-9]", "")), "")
    one = F.transform(plain, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(one, F.lit(0), lambda t, x: t + F.coalesce(x, F.lit(0))) % 10


def iban_rest(iban: Column) -> Column:
    """The rest of an account number modulo 97, its first four characters last; 1 is right."""
    plain = F.upper(F.regexp_replace(iban, "[^A-Za-z0-9]", ""))
    marks = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(marks, F.lit(0), lambda t, c: F.when(c == "", t).otherwise((t * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.coalesce(value(c), F.lit(0))) % 97))


def keyed(entity: Column, kind: Column, turn: Column, key: str) -> Column:
    """The surrogate: every character is replaced within its class by hash bytes of key, entity, round and place."""
    seed = hmac(F.concat_ws("|", kind, turn.cast("string"), entity), key)
    marks = F.split(entity, "")
    number = lambda c: F.conv(F.substring(F.sha2(F.concat_ws("|", seed, c), 256), 1, 8), 16, 10).cast("long")

    def swap(c: Column, i: Column) -> Column:
        pick = lambda chars: F.substring(F.lit(chars), (number(i.cast("string")) % len(chars) + 1).cast("int"), F.lit(1))
        name = kind == "name"
        out = F.when(c.rlike("[0-9]"), pick(DIGITS)).when(name & c.rlike("[aeiou]"), pick(VOWELS)).when(name & c.rlike("[a-z]"), pick(CONSONANTS))
        out = out.when(name & c.rlike("[AEIOU]"), pick(VOWELS.upper())).when(name & c.rlike("[A-Z]"), pick(CONSONANTS.upper()))
        out = out.when(c.rlike("[a-z]"), pick(LOW)).when(c.rlike("[A-Z]"), pick(CAP))
        for have, give in SCRIPTS:
            out = out.when(F.contains(F.lit(have), c), pick(give))
        out = out.when(c.rlike(r"\p{Lu}"), pick(CAP)).when(c.rlike(r"\p{L}"), pick(LOW)).when(c.rlike(r"\p{N}"), pick(DIGITS))
        return out.when(~entity.rlike(r"[\p{L}\p{N}]"), pick(LOW)).otherwise(c)

    plain = F.array_join(F.transform(marks, swap), "")
    behind = lambda n: F.concat(F.substring(entity, F.lit(1), n), F.substring(plain, n + 1, F.length(entity)))
    more = F.transform(F.sequence(F.lit(1), F.greatest(turn - GROW, F.lit(1))), lambda i: (number(F.concat(F.lit("more"), i.cast("string"))) % 10).cast("string"))
    grown = F.when(turn > GROW, F.array_join(more, "")).otherwise(F.lit(""))
    hexa = F.substring(F.concat(seed, F.sha2(F.concat(seed, F.lit("+")), 256)), F.lit(1), F.length(entity))
    hexa = F.when(entity.rlike("^[0-9a-f]+$"), hexa).when(entity.rlike("^[0-9A-F]{40}$"), F.upper(hexa))
    octet = lambda i: (number(F.lit(i)) % 254 + 1).cast("string")
    mail = F.concat(F.substring_index(plain, "@", 1), grown, F.lit("@"), F.regexp_replace(F.element_at(F.split(plain, "@"), 2), r"\..*$", ""), F.lit(".example.org"))
    prefixed = F.when(entity.rlike("(?i)^akia"), behind(F.lit(4))).when(entity.rlike("(?i)^gh[pousr]_"), behind(F.lit(4)))
    ip = F.concat(F.lit("10."), octet("1"), F.lit("."), octet("2"), F.lit("."), octet("3"))
    card = F.concat(F.substring(behind(F.lit(1)), F.lit(1), F.length(entity) - 1), F.lit("0"))
    card = F.concat(F.substring(card, F.lit(1), F.length(entity) - 1), ((10 - luhn(card)) % 10).cast("string"))
    account = F.concat(F.substring(entity, 1, 2), F.lit("00"), F.substring(behind(F.lit(4)), F.lit(5), F.length(entity)))
    account = F.concat(F.substring(entity, 1, 2), F.lpad((98 - iban_rest(account)).cast("string"), 2, "0"), F.substring(account, F.lit(5), F.length(entity)))
    code = F.length(F.regexp_extract(entity, r"^(\+[0-9]{1,3}(?=[ .-])|\+[0-9]{2})", 1))
    other = F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", account).when(kind == "phone", behind(code))
    other = other.when((kind == "secret") & prefixed.isNotNull(), prefixed).when((kind == "secret") & hexa.isNotNull(), hexa).otherwise(plain)
    given = F.lower(entity)
    for names, end in ((FEMALE, "a"), (MALE, "o")):
        other = F.when((kind == "name") & given.isin(*names.split()), F.concat(F.substring(plain, F.lit(1), F.length(entity) - 1), F.when(entity == F.upper(entity), F.lit(end.upper())).otherwise(F.lit(end)))).otherwise(other)
    return F.when(kind == "email", mail).otherwise(F.concat(other, grown))


def surrogate_table(entities: DataFrame, key: str | None = None) -> DataFrame:
    """entity, uses, kind, surrogate for entities(entity, uses), one row each; surrogates are distinct and no real entity."""
    key = key or session_key(entities.sparkSession)
    table = stored(entities.withColumn("kind", kind_of(F.col("entity"))).withColumn("turn", F.lit(0)).withColumn("surrogate", keyed(F.col("entity"), F.col("kind"), F.col("turn"), key)), "surrogates")
    while True:
        first = table.groupBy("surrogate").agg(F.min("entity").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        real = table.select(F.col("entity").alias("surrogate"))
        lost = table.join(first, "surrogate").filter("entity <> winner").select("entity")
        lost = stored(lost.unionByName(table.join(real, "surrogate", "left_semi").select("entity")).distinct().withColumn("lost", F.lit(True)), "collisions")
        if lost.isEmpty():
            return table.drop("turn")
        turn = F.col("turn") + F.when(F.col("lost"), 1).otherwise(0)
        table = stored(table.join(lost, "entity", "left").withColumn("turn", turn).withColumn("surrogate", F.when(F.col("lost"), keyed(F.col("entity"), F.col("kind"), F.col("turn"), key)).otherwise(F.col("surrogate"))).drop("lost"), "surrogates")


def replace_entities(docs: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, n_entities, spans) for every row of docs(doc_id, text), and the surrogate table. spans: place of the entity, kind and surrogate."""
    spark = docs.sparkSession
    key = key or session_key(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    may = F.col("text").rlike("[0-9@]|(?i:password=|akia|gh[pousr]_)")
    for sign in SIGNS:
        may = may | F.contains("text", F.lit(sign))
    # One pass of the patterns over the texts. Rows without an entity keep nothing but their number.
    found = F.when(may, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    found = F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda e: F.struct(e.alias("e"), real(e).alias("real")))
    marked = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", found.alias("found"))
    marked = stored(marked.withColumn("has", F.exists("found", lambda x: x["real"])), "pii-marked", compression="zstd")
    hits = marked.filter("has").select("row", "doc_id", "text", "found")
    uses = hits.select("row", F.posexplode("found").alias("place", "x")).filter("x.real").select("row", "place", F.col("x.e").alias("found"), kind_of(F.col("x.e")).alias("kind"))
    forms = F.when(F.col("kind") == "name", F.split("found", " ")).when(F.col("kind") == "email", F.array(F.lower("found"))).otherwise(F.array("found"))
    uses = stored(uses.select("row", "place", F.col("kind").alias("of"), F.posexplode(forms).alias("part", "entity")), "pii-uses")
    table = surrogate_table(uses.groupBy("entity").agg(F.count(F.lit(1)).alias("uses")), key)
    mapped = join_hot(uses, table, "entity", "uses", uses.count(), "inner").groupBy("row", "place").agg(F.array_sort(F.collect_list(F.struct("part", "entity", "surrogate"))).alias("parts"), F.first("of").alias("kind"))
    whole = F.struct("place", "kind", F.array_join("parts.surrogate", " ").alias("surrogate"))
    said = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == "name", F.transform("parts", lambda x: F.struct(x["entity"].alias("entity"), x["surrogate"].alias("surrogate")))))))
    mapped = mapped.groupBy("row").agg(F.array_sort(F.collect_list(whole)).alias("spans"), said.alias("said"))

    def untitled(piece: Column) -> Column:
        """Names of the document without a title; no surrogate is a real name, so one replacement never meets another's result."""
        return F.aggregate("said", piece, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), x["entity"], F.lit(r"(?![\p{L}\p{N}])")), x["surrogate"]))

    # What the patterns found but is no entity stays as it is.
    at = F.map_from_arrays("spans.place", "spans.surrogate")
    text = F.array_join(F.transform(F.split("text", ANY), lambda p, i: F.concat(untitled(p), F.coalesce(F.try_element_at(at, i), F.get(F.col("found.e"), i), F.lit("")))), "")
    done = hits.join(mapped, "row").select("doc_id", text.alias("text"), F.size("spans").cast("long").alias("n_entities"), "spans")
    none = marked.filter("not has").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast(done.schema["spans"].dataType).alias("spans"))
    return done.unionByName(none), table


def real(found: Column) -> Column:
    """Whether what the patterns found is an entity: digits in the form of a card need a right check digit."""
    card = found.rlike(rf"^(?:{PATTERNS['card']})$")
    return ~card | (luhn(found) == 0)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


QUERIES, ORACLES = {"op10_pii_surrogates": op10_pii_surrogates}, {}
