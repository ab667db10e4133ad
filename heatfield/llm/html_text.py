"""Main text of pages: page structure first, then repeats across the pages of a host.

A page is parsed into blocks. Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles
(by element, role or class) are boilerplate; inside an article class words only lower the cover that a block needs to go,
save whole names of adverts and comments. All other blocks, in an article or not, are judged by repeats: a block that runs
of RUN tokens cover to COVER goes, if these runs occur on enough distinct pages of the host. Outside articles, and beside a
class word, PAGES are enough; a plain block of an article goes only by runs on SITE_PAGES pages or more that
are SITE_SHARE of the host's distinct pages or more, so a line that some articles share stays and a site-wide notice goes.

The runs are found as in a suffix array of depth RUN that is dealt over tasks by the hash of host and prefix, so no task
needs a whole host: suffixes with one prefix of RUN tokens meet in a groupBy that combines before the shuffle. Not all
suffixes are sent. A run can be frequent only if its grams of GRAM tokens are, so the least gram (by hash) of each run
is counted first, about a third as many rows, and only runs whose least gram may decide a block (on PAGES pages with a
block that PAGES decide among them, or on as many as the host's articles ask for) by a sketch of fixed size
are counted themselves, exactly up to equal 64-bit hashes. repeated() is the same search by one suffix array in memory.

Defined results: null html gives an empty text; a null url is a host of its own kind; pages of a host with the same
blocks count as one page in the search for repeats, so copies of an article do not drop it; a block of fewer tokens than
RUN goes only where runs over it and its neighbours cover it; repeated pages repeat their result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.llm.common import BROADCAST_ROWS, checked_broadcast, join_hot, stored

RUN, PAGES, COVER = 8, 3, 0.8
#: Distinct pages of the host, and their share, that have a run by which a plain block of an article goes.
SITE_PAGES, SITE_SHARE = 8, 0.5
#: Tokens of a gram; bits of the sketch of frequent grams, as a power of 2.
GRAM, SKETCH = 4, 24
#: Elements and class words.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
DROP = {"script", "style", "noscript", "template", "title", "head", "svg", "nav", "header", "footer", "aside", "button", "select", "textarea", "iframe", "object", "dialog", "menu", "canvas"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
WORDS = re.compile(r"(?:^|[\s_-])(ad|ads|advert|adverts|advertisement|sponsored|promo|sidebar|side|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|footer|cookie|cookies|consent|notice|banner|popup|modal|newsletter|subscribe|signup|login|comment|comments|replies|disqus|share|sharing|social|related|recommended|widget|pagination|pager)(?=$|[\s_-]|\d)", re.I)
#: Whole class names and ids that mark adverts and comments anywhere; the other words only count outside articles.
STRONG = re.compile(r"(?:^|\s)(ad|ads|advert|adverts|advertisement|sponsored|comment|comments|disqus)(?=$|\s)", re.I)
#: A block with a class word inside an article goes if repeats cover this much of it.
KEEP, GONE, OPEN, HINT = 0, 1, 2, 3
HINT_COVER = 0.5
#: No page is asked for where a host has too few for its articles to be judged.
NEVER = (1 << 31) - 1
FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool, tuple[int, ...], list[str]]] = []  # element, boilerplate, in an article, class word there, forms, skip outside
        self.blocks: list[tuple[str, int, tuple[int, ...]]] = []
        self.words: list[str] = []
        self.skip: list[str] = []  # open inline elements from an advert or comment on
        self.forms = 0
        self.holders: set[int] = set()  # forms with an article

    def top(self):
        return self.stack[-1] if self.stack else ("", False, False, False, (), [])

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            _, gone, article, hint, forms, _ = self.top()
            self.blocks.append((text, GONE if gone else HINT if hint else KEEP if article else OPEN, forms))

    def close_to(self, i):
        self.skip = self.stack[i][5]
        del self.stack[i:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.words.append(" ")
        a = {k: v or "" for k, v in attrs}
        names = f"{a.get('class', '')} {a.get('id', '')}"
        if tag in INLINE or tag == "br":
            if tag not in VOID and (self.skip or STRONG.search(names)):
                self.skip.append(tag)
            return
        self.flush()
        if tag in VOID:
            return
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
            for i in range(len(self.stack) - 1, -1, -1):  # these close one another
                if self.stack[i][0] == tag:
                    self.close_to(i)
                    break
                if self.stack[i][0] not in ("p", "td", "th"):
                    break
        _, gone, article, hint, forms, _ = self.top()
        is_main = tag in ("article", "main") or a.get("role") == "main" or a.get("itemprop") == "articleBody"
        drop = tag in DROP and not (tag == "header" and article) or a.get("role") in ROLES - {"form"} or "hidden" in a
        word = tag not in ("html", "body", "article", "main") and bool(WORDS.search(names))
        drop = drop or word and not article and not is_main or tag not in ("html", "body", "main") and bool(STRONG.search(names))
        if tag == "form" or a.get("role") == "form":
            self.forms += 1
            forms = (*forms, self.forms)
        if is_main and not (gone or drop or self.skip):
            self.holders.update(forms)
        self.stack.append((tag, gone or drop or bool(self.skip), article or is_main, hint or word and article, forms, self.skip))
        self.skip = []

    def handle_endtag(self, tag):
        if tag in INLINE or tag in VOID:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.close_to(i)
                return

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def blocks(html: str | None) -> list[tuple[str, int]]:
    """Blocks of a page in order, each with KEEP (in an article), GONE, OPEN or HINT (in an article, with a class word).

    A form is boilerplate unless it holds an article or nothing is left without it.
    """
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    free = [(t, GONE if set(forms) - p.holders else k) for t, k, forms in p.blocks]
    return free if any(k != GONE for _, k in free) else [(t, k) for t, k, _ in p.blocks]


def suffix_ranks(a: np.ndarray, run: int) -> np.ndarray:
    """Ranks of all suffixes by their first `run` entries or more (prefix doubling); equal ranks share that prefix."""
    rank, span = np.unique(a, return_inverse=True)[1].astype(np.int64), 1
    while span < run:
        step = min(span, run - span)
        after = np.full(len(a), -1, np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(a) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        span += step
    return rank


def repeated(streams: list[list[str]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a run of `run` tokens that `pages` distinct pages have."""
    ids: dict[str, int] = {}
    parts, owner = [], []
    for k, s in enumerate(streams):
        parts.append(np.array([ids.setdefault(w, len(ids)) for w in s] + [-1 - k], np.int64))
        owner.append(np.full(len(s) + 1, k))
    if not parts:
        return []
    a, own = np.concatenate(parts), np.concatenate(owner)
    covered = np.zeros(len(a) + 1, np.int64)
    if len(a) > run:
        rank = suffix_ranks(a, run)
        order = np.lexsort((own, rank))  # the suffix array, pages in order within a shared prefix
        r, o = rank[order], own[order]
        first = np.r_[True, (r[1:] != r[:-1]) | (o[1:] != o[:-1])]
        distinct = np.bincount(r[first], minlength=rank.max() + 1)
        at = np.flatnonzero(distinct[rank] >= pages)
        at = at[at + run <= len(a)]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + run, -1)
    hit = np.cumsum(covered)[:-1] > 0
    ends = np.cumsum([len(p) for p in parts])
    return [hit[e - len(p) : e - 1] for p, e in zip(parts, ends, strict=True)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[x for x in blocks(html) if x[1] != GONE] for html in batch.column(3).to_pylist()]
        texts = pa.array([[t for t, _ in x] for x in found], pa.list_(pa.string()))
        lens = pa.array([[len(t.split(" ")) for t, _ in x] for x in found], pa.list_(pa.int32()))
        kinds = pa.array([[k for _, k in x] for x in found], pa.list_(pa.int32()))
        copies = pa.array([int.from_bytes(hashlib.blake2b("\n".join(t for t, _ in x).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts, lens, kinds, copies], ["row", "page_id", "url", "blocks", "lens", "kinds", "copy"])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _grams(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n tokens from each place on; empty where there are fewer."""
    m = max(len(tokens) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = _mixed(out + tokens[j : j + m])
    return out


PAGE = ("row", "host", "blocks", "kinds", "copy", "need")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """For each page (PAGE) with a run: row, run hashes by place, the least gram of each run, whether it touches a block that PAGES decide, hash of the blocks, need."""
    pages, kinds = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    words = [[w for t in p for w in [*t.split(" "), "\n"]] for p in pages]
    flat = np.array([w for p in words for w in p] or [""], object)
    token = pd.util.hash_array(flat, categorize=True)
    hosts = pd.util.hash_array(np.array(batch.column(1).to_pylist(), object))
    ends = np.cumsum([len(p) for p in words])
    for row, host, p, k, copy, need, w, end in zip(batch.column(0).to_pylist(), hosts, pages, kinds, *(batch.column(c).to_pylist() for c in (4, 5)), words, ends, strict=True):
        if len(w) >= RUN:
            mine = token[end - len(w) : end]
            least = np.lib.stride_tricks.sliding_window_view(_grams(mine, GRAM), RUN - GRAM + 1).min(axis=1)
            loose = np.r_[0, np.cumsum(np.repeat(np.array(k) != KEEP, [len(t.split(" ")) + 1 for t in p]))]
            yield row, _mixed(_grams(mine, RUN) + host), _mixed(least + host), loose[RUN:] > loose[:-RUN], copy, need


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, looses, needs = [], [], []
        for _, _, least, loose, _, need in _runs(batch):
            keys.append(np.unique(gram := least.astype(np.uint32)))
            looses.append(np.isin(keys[-1], gram[loose]))
            needs.append(np.full(len(keys[-1]), need, np.int32))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int32)), pa.array(np.concatenate(looses)), pa.array(np.concatenate(needs))], ["gram", "loose", "need"])


def _sketch(pages: DataFrame) -> np.ndarray:
    """2^SKETCH bits: those of the grams that stand for runs on enough rows. False hits only cost work."""
    grams = pages.select(*PAGE).mapInArrow(_least, "gram int, loose boolean, need int").groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.bool_or("loose").alias("loose"), F.min("need").alias("need"))
    grams = grams.filter(f"n >= {PAGES} and loose or n >= need")
    bit = F.col("gram").bitwiseAND((1 << SKETCH) - 1).cast("long") + 1
    parts = grams.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(((1 << SKETCH) // 32768, 4096), np.uint8)
    for r in stored(parts, "gram-bits", FEW).collect():
        out[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row and the places of the blocks that runs cover enough, for (row, lens, kinds, need, runs(at, copies))."""
    for batch in batches:
        rows, gone = [], []
        for row, lens, kinds, need, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ends, at, copies = np.cumsum(np.array(lens) + 1), np.array([r["at"] for r in runs]), np.array([r["copies"] for r in runs])
            hits = []
            for mine in (at, at[copies >= need]):
                marks = np.zeros(ends[-1] + 1, np.int64)
                np.add.at(marks, mine, 1)
                np.add.at(marks, mine + RUN, -1)
                hits.append(np.cumsum(marks) > 0)
            if found := [i for i, (n, e, k) in enumerate(zip(lens, ends, kinds, strict=True)) if hits[k == KEEP][e - 1 - n : e - 1].mean() >= (HINT_COVER if k == HINT else COVER)]:
                rows.append(row)
                gone.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["row", "gone"])


def _with_need(pages: DataFrame) -> DataFrame:
    """pages(host, copy) with need: the pages on which a run must occur for a plain block of an article to go."""
    sizes = pages.groupBy("host", "copy").agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(F.count(F.lit(1)).alias("copies"), F.sum("n").alias("n"))
    need = F.greatest(F.lit(SITE_PAGES), F.ceil(F.col("copies") * SITE_SHARE)).cast("int")
    sizes = stored(sizes.filter(F.col("copies") >= SITE_PAGES).select("host", need.alias("need"), "n"), "hosts")
    if sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = pages.join(F.broadcast(sizes), "host", "left")
    else:
        out = join_hot(pages, sizes, "host", "n", pages.count())
    return out.drop("n").withColumn("need", F.coalesce("need", F.lit(NEVER)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    schema = "row long, page_id long, url string, blocks array<string>, lens array<int>, kinds array<int>, copy long"
    parsed = stored(rows.mapInArrow(_parse, schema), "pages", FEW, compression="zstd", **{"parquet.compression.codec.zstd.level": "9"})
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))
    hosts = _with_need(parsed.withColumn("host", host))
    sketch = spark.sparkContext.broadcast(_sketch(hosts))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, low = sketch.value, np.uint64((1 << SKETCH) - 1)
        for batch in batches:
            found = []
            for row, run, least, _, copy, _ in _runs(batch):
                bit = least & low
                at = np.flatnonzero(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                if len(at):
                    found.append((np.full(len(at), row, np.int64), at.astype(np.int32), run[at].view(np.int64), np.full(len(at), copy, np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["row", "at", "run", "copy"])

    runs = stored(hosts.select(*PAGE).mapInArrow(likely, "row long, at int, run long, copy long"), "runs", FEW, compression="zstd")
    often = runs.groupBy("run", "copy").agg(F.count(F.lit(1)).alias("n")).groupBy("run").agg(F.count(F.lit(1)).alias("copies"), F.sum("n").alias("uses"))
    often = stored(often.filter(F.col("copies") >= PAGES).select("run", "copies", "uses"), "repeats")
    mine, few = runs.select("row", "at", "run"), often.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hits = mine.join(F.broadcast(often), "run") if few else join_hot(mine, often, "run", "uses", runs.count(), "inner")
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("at", "copies")).alias("runs"))
    gone = stored(hosts.select("row", "lens", "kinds", "need").join(hits, "row").select("row", "lens", "kinds", "need", "runs").mapInArrow(_gone, "row long, gone array<int>"), "gone", FEW)
    left = F.filter("blocks", lambda t, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    judged = parsed.join(checked_broadcast(gone), "row", "left").select("page_id", "url", F.array_join(left, "\n").alias("text"))
    return judged.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES, ORACLES = {"op8_html_text": op8_html_text}, {}
