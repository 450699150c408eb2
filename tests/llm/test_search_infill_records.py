import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from stillgood.llm import infill, records, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = {}
    for item, text in items.items():
        found = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if c[t])
            found += [(-score, i is None, i or 0)] if score > 0 else []
        out[item] = [(-s, None if none else i) for s, none, i in sorted(found)[:k]]
    return out


def ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.score, r.id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_terms_are_those_of_the_pattern():
    for text in ["A-b_c9 \x00x\x7fy", "Été ÉA ß\xa0z—q 中文 \U0001f600X", "", None, "...", "aB1" * 9]:
        assert [t.decode() for t in search.terms(text)] == plain_terms(text)


def test_search_on_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "a B, word5 zzz"), (2, None), (3, "..."), (4, "mail EXAMPLE org café 中文"), (5, "one one"), (5, "more"), (None, "a"), (6, "")]
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x")).withColumn("id", F.lit(1)).withColumn("block", F.lit(1))
    plain = plain_search([(r.doc_id, r.text) for r in odd_docs.collect()], {1: "a B, word5 zzz", 4: "mail EXAMPLE org café 中文", 5: "one one more"}, 3)
    for block_chars in (40, search.BLOCK_CHARS):
        got = ranked(search.search(search.build_index(odd_docs, block_chars=block_chars), queries, "item_id", k=3).collect())
        assert got == {q: v for q, v in plain.items() if v}
    assert search.search(search.build_index(no_docs), queries, "item_id").count() == 0
    assert search.search(search.build_index(odd_docs), queries.limit(0), "item_id").count() == 0


@pytest.mark.parametrize("query_terms", [search.QUERY_TERMS, 20])
def test_search_skips_and_stays_exact(spark, monkeypatch, query_terms):
    """Many windows, short and long lists, ties; queries in one job and in several."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    chance = 1 / np.arange(1, 401)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 40)), p=chance / chance.sum()))) for i in range(3000)]
    rows += [(3000 + i, rows[i % 7][1]) for i in range(60)]
    items = {i: " ".join(rng.choice(words, 8)) for i in range(12)}
    monkeypatch.setattr(search, "WINDOW", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    queries = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = ranked(search.search(search.build_index(docs), queries, "item_id", k=5, query_terms=query_terms).collect())
    assert got == plain_search(rows, items, 5)


def test_windows_are_skipped(monkeypatch):
    """One good document early and a long list of poor ones: most postings are never scored."""
    monkeypatch.setattr(search, "WINDOW", 64)
    n = 20_000
    block = search._Block(list(range(n)), np.full(n, 10), n, 10 * n)
    every = np.arange(n).astype("<u2").tobytes()
    block.packed = {"common": (every, np.r_[np.full(10, 9), np.ones(n - 10, int)].astype("<u1").tobytes(), 1), "rare": (np.arange(10).astype("<u2").tobytes(), np.ones(10, "<u1").tobytes(), 1)}
    docs, scores, scored = block.search([("common", 1), ("rare", 9000)], 1, 5)
    assert docs.tolist() == [0, 1, 2, 3, 4] and len(set(scores.tolist())) == 1 and scored < 200


def plain_cut(row_id, text):
    h = hashlib.sha256(f"1:{row_id if row_id is not None else ''}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def seed(c="doc_id"):
    return F.concat(F.lit("1:"), F.coalesce(F.col(c).cast("string"), F.lit("")))


def test_fill_in_middle(spark, odd_docs, no_docs):
    tricky = ["x", "\n", "\r\n\r\n", "a<P>b", "<<P<S<M>x"[:6], "$1\\2{3}", "\U0001f600" * 3000 + "é\n", "<" * 2000, "ab \x85c" * 700, "x" * 3_000_000, "<S", "M><M", ">>>"]
    docs = odd_docs.select("doc_id", "text", F.lit(7).alias("n"), F.lit("f").alias("form"), F.lit("o").alias("_n"))
    for i in range(4):
        docs = docs.unionByName(spark.createDataFrame([(100 * i + j, t, 7, "f", "o") for j, t in enumerate(tricky)], docs.schema))
    got = infill.split_form(docs, seed()).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in got) == Counter((r.doc_id, *plain_cut(r.doc_id, r.text or "")) for r in docs.collect())
    assert all(r.back == (r.text or "") for r in got) and {"psm", "spm", "plain"} == {r.form for r in got}
    assert infill.split_form(no_docs, seed()).count() == 0


def test_fill_in_middle_by_words(spark):
    """Words with the white space after them, and what white space comes first, as units."""
    unit = r"(?:\S++\s*+|\s++)"
    docs = spark.createDataFrame([(i, "  one two\nthree " * (i % 40)) for i in range(200)], "doc_id long, text string")
    for r in infill.split_form(docs, seed(), unit=unit).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect():
        units = re.findall(r"\S+\s*|\s+", r.text)
        assert r.n == len(units) and r.back == r.text
        if r.form == "psm":
            assert r.output.startswith("<P>" + "".join(units[: r.prefix_units]) + "<S>")


def vocabulary(name="word_bpe_49k.json"):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


TRICKY = ["it's WE'LL 'S x́ J̌ Å Ç", "a  b \n\n c\x1c\x85d\xa0e", "½Ⅷ 中\U00010400\U0001f600 ﬁ", "Ünïcode, ÉTÉ. ß! µ ª İI ſ K Ω Σς", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
          "word). end.. x.y, 12,5 a1. é, é.. ý; ÿ", "̈ alone  ̈", "\x00\x01 \x7f", "(a) [b] -c. d-. 'tis, 's, ''s. don't.", "ǅ Ǆ ﬀ. ŉ, ĳ! Ａ", " x  ﻿y", "가 가 각"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name, odd_docs):
    plain, own = tokenizers.Tokenizer.from_str(vocabulary(name)), records.Encoder(vocabulary(name))
    assert own.by_words == name.startswith("word")
    texts = [r.text or "" for r in odd_docs.collect()] + TRICKY + ["".join(TRICKY), " ".join(TRICKY)]
    for text in texts + texts:
        assert own.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_every_latin_letter_as_a_word():
    plain, own = tokenizers.Tokenizer.from_str(vocabulary()), records.Encoder(vocabulary())
    for c in map(chr, [*range(0x21, 0x600), *range(0x1E00, 0x2100), 0xFB01, 0x1F600]):
        for text in (c, f"a{c}", f"{c}b.", f"x{c},{c}", f"{c}'s", f"J{c} A{c}."):
            assert own.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(records, "KEPT_WORDS", 10)
    plain, own = tokenizers.Tokenizer.from_str(vocabulary()), records.Encoder(vocabulary())
    for i in range(60):
        text = f"alpha{i} beta gamma{i % 7}, delta{i}"
        assert own.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(own.kept) + len(own.older) <= 10


def plain_rows(docs, end=2):
    plain = tokenizers.Tokenizer.from_str(vocabulary())
    rows = sorted(((r.doc_id is None, r.doc_id or 0), plain.encode(r.text or "", add_special_tokens=False).ids + [end]) for r in docs.select("doc_id", "text").collect())
    return [(None if none else i, ids) for (none, i), ids in rows]


@pytest.mark.parametrize("task_chars", [50_000, records.TASK_CHARS])
def test_records_round_trip(spark, odd_docs, no_docs, tmp_path, monkeypatch, task_chars):
    records.write_tokens(odd_docs, f"file://{tmp_path}/t", vocabulary(), end_id=2, task_chars=task_chars)
    rows, want = records.read_tokens(spark, f"file://{tmp_path}/t").collect(), plain_rows(odd_docs)
    assert Counter((r.id, tuple(np.frombuffer(r.ids, "<u4"))) for r in rows) == Counter((i, tuple(x)) for i, x in want)
    ids = sorted(rows, key=lambda r: r.start)
    assert [r.id for r in ids] == [i for i, _ in want]
    assert [r.start for r in ids] == np.cumsum([0] + [r.n_tokens for r in ids])[:-1].tolist()
    shuffled = [[(r.id, bytes(r.ids)) for r in records.read_shuffled(spark, f"file://{tmp_path}/t", s, tasks=2).collect()] for s in (1, 1, 2)]
    assert shuffled[0] == shuffled[1] != shuffled[2] and sorted(map(str, shuffled[0])) == sorted(map(str, shuffled[2])) == sorted(str((r.id, bytes(r.ids))) for r in rows)
    records.write_tokens(no_docs, f"{tmp_path}/none", vocabulary(), end_id=2)
    assert records.read_tokens(spark, f"{tmp_path}/none").count() == records.read_shuffled(spark, f"{tmp_path}/none", 1).count() == 0


def test_files_roll_and_a_lost_attempt_counts_for_nothing(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i % 50, f"text number {i}") for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(records, "FILE_BYTES", 700)
    index = records.write_tokens(docs, str(tmp_path / "t"), vocabulary(), task_chars=3000)
    assert index.select("file").distinct().count() > 5
    (tmp_path / "t/data/000000-0000-lost.rec").write_bytes(b"half a record")
    rows = records.read_tokens(spark, str(tmp_path / "t")).collect()
    assert len(rows) == 400 and [r.id for r in sorted(rows, key=lambda r: r.start)] == sorted(i % 50 for i in range(400))


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    records.write_tokens(docs, str(tmp_path / "t"), vocabulary())
    [file] = (tmp_path / "t/data").iterdir()
    good = file.read_bytes()
    assert records.unframe(good)[1] == len(good)
    for at in range(len(good)):
        with pytest.raises(ValueError):
            records.unframe(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
        with pytest.raises(ValueError):
            records.unframe(good[:at])
    file.write_bytes(good + b"x")
    with pytest.raises(Exception, match="holds more"):
        records.read_tokens(spark, str(tmp_path / "t")).collect()


def test_wide_ids_and_checksums():
    ids = np.array([1, 70_000], np.uint32)
    assert records.unpack(records.pack(None, ids))[0] is None and records.unpack(records.pack(-5, ids))[1].tolist() == [1, 70_000]
    crc = zlib.crc32(b"abc")
    assert records.masked(b"abc") == (((crc >> 15) | (crc << 17) & 0xFFFFFFFF) + 0xA282EAD8) % 2**32
    assert json.loads(vocabulary())["model"]["end_of_word_suffix"] == "</w>"
