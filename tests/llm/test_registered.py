"""Every registered query of the corpus operators on the smallest tables, against SQL or brute force."""

import collections
import hashlib
import itertools
import os
import re
import zlib
from html import unescape

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from heatfield.llm.queries import ORACLES, QUERIES

DIR = os.environ.get("HEATFIELD_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.fixture(scope="module")
def rows(duck):
    return duck.execute("SELECT doc_id, coalesce(text, ''), lang FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    got, cur = QUERIES[name](spark, DIR), duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    plain = lambda r: repr([round(v, 5) if isinstance(v, float) else v for v in r])
    assert sorted(map(plain, got.select(*cols).collect())) == sorted(map(plain, cur.fetchall()))


def test_sentencepiece(spark, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = {r.doc_id: r for r in QUERIES["op2_sentencepiece"](spark, DIR).collect()}
    assert len(got) == len(rows) and all(got[i].ids == library.encode(t) and got[i].round_trip for i, t, _ in rows)


def test_media(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op3_media_columns"](spark, DIR).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        raw = t.encode()
        pad = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        lines = t.split("\n")
        half = len(lines) // 2
        assert (got[i].position, got[i].caption) == (int(any(x.split() for x in lines[:half])), f"document {i}, behind line {half}")
    assert {r.position for r in got.values()} == {0, 1}


def test_token_files(spark, rows):
    plain, at = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), 0
    got = {r.doc_id: r for r in QUERIES["op5_token_files"](spark, DIR).collect()}
    for i, t, _ in sorted(rows):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_licenses_lie_in_the_texts(spark, rows):
    texts = {i: t for i, t, _ in rows}
    got = QUERIES["op6_license_scan"](spark, DIR).collect()
    assert got and all(r.license and r.doc_id in texts for r in got)


def test_language(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, DIR).collect()}
    held = [(i, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 3 == 1 and re.search(r"[^\W\d_]", t)]
    assert len(got) == len(rows) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert all((got[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", t)) for i, t, _ in rows)


def test_main_text(spark, duck):
    pages = dict(duck.execute("SELECT page_id, url FROM pages").fetchall())
    got = QUERIES["op8_html_text"](spark, DIR).collect()
    assert {r.page_id: r.url for r in got} == pages and all(r.n_chars == len(r.text) and "<" not in r.text and "  " not in r.text for r in got)


def test_jaccard(spark, rows):
    sets, up = {}, {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset()
        up[i] = i

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        if 100 * (c := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_jaccard_join"](spark, DIR).collect()}
    assert got == {i: (len(s), top(i)) for i, s in sets.items()}


def test_surrogates(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op10_pii_surrogates"](spark, DIR).collect()}
    assert len(got) == len(rows)
    said = collections.Counter()
    for i, t, _ in rows:
        mails = set(re.findall(r"[\w.]+@mail\d\.example\.com", t))
        assert not any(m in (got[i].text or "") for m in mails)
        assert got[i].n_entities or (got[i].text or "") == t
        said["mail"] += len(mails)
    assert said["mail"]


def test_main_text_is_the_heading_and_the_document(spark, duck):
    """A page's text is its h1 and, line by line, the document whose number ends the url."""
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    html = dict(duck.execute("SELECT page_id, html FROM pages").fetchall())
    squeezed, seen = lambda t: " ".join(t.split()), 0
    for r in QUERIES["op8_html_text"](spark, DIR).collect():
        number = int(re.search(r"example.\w+/\w+/(\d+)", r.url)[1])
        head = squeezed(unescape(re.search(r"<h1[^>]*>(.*?)</h1>", html[r.page_id], re.S)[1]))
        lines = [x for t in texts[number].split("\n") if (x := squeezed(t))] if number in texts else None
        if lines is not None:
            seen += 1
            assert r.text == "\n".join(x for x in [head, *lines] if x), r.page_id
    assert seen
