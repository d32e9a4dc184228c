"""Operators 11 to 13 against plain versions and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import divergence as D
from docloom.llm import sharding as S
from docloom.llm import vector_codes as V
from docloom.llm.queries import LLM_QUERIES
from tests.llm.conftest import CLEAN, LONG, ROWS, SCHEMA

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- 11: source divergence

def plain_divergence(rows, least=3, top=200):
    n, df, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = TERM.findall(lower(text))
        for w in words:
            n[lang, source, w] += 1
        for w in set(words):
            df[lang, w] += 1
    out = []
    for lang, sources in groups.items():
        kept = [w for (l, w), k in df.items() if l == lang and k >= least]
        v = len(kept)

        def shares(count):
            total = sum(count.values())
            return {w: 1 + (D.SCALE * (count[w] + 1)) // (total + v) for w in kept}

        counts = {s: {w: n[lang, s, w] for w in kept} for s in sources}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares({w: sum(counts[s][w] for s in sources) for w in kept})
        for s in sources:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in sources if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:top if part == "term" else None]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items)]
    return sorted(out)


def divergence_rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_multikey_sort_orders_words_and_groups_them(monkeypatch):
    rng = random.Random(3)
    stems = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghabcdefgh", "abcdefghabcdefghz", "ÄÖ", "zażółćgęślą", "Z" * 40]
    words = [rng.choice(stems) + rng.choice(["", "x", "yy", "q" * rng.randint(1, 30)]) for _ in range(5000)]
    p = D.Pointers(pa.array([" ".join(words[:2500]), None, "", "7" + "-".join(words[2500:])]))
    want = [lower(w).encode() for w in words]
    for small in (1, 16, D.SMALL):                         # by partitions alone, mixed, sorted outright
        monkeypatch.setattr(D, "SMALL", small)
        order, run = D.multikey_sort(p, np.arange(len(p.start)))
        got = [w.encode() for w in p.spelling(order).to_pylist()]
        assert got == sorted(want)
        assert run.tolist() == np.cumsum([0] + [a != b for a, b in zip(got, got[1:])]).tolist()


def test_words_end_where_a_text_ends():
    texts = pa.array(["skip", "ab", "cd", "", None, "é", "éa1b", "_x", "y"])[1:]
    p = D.Pointers(texts)
    assert p.spelling(np.arange(len(p.start))).to_pylist() == ["ab", "cd", "é", "éa", "b", "x", "y"]
    assert p.doc.tolist() == [0, 1, 4, 5, 5, 6, 7]


def test_a_long_text_counts_once_whatever_the_slice(monkeypatch):
    texts = pa.array([LONG, CLEAN, LONG + " " + CLEAN, CLEAN])
    group = np.array([1, 0, 1, 0])
    want = Counter(), Counter()
    for t, g in zip(texts.to_pylist(), group):
        w = TERM.findall(lower(t))
        want[0].update((x, g) for x in w)
        want[1].update((x, g) for x in set(w))
    for most in (7, 1000, 1 << 20):
        got = Counter(), Counter()
        for t, g, n, d in zip(*(x.tolist() for x in D.term_counts(texts, group, most))):
            got[0][t, g] += n
            got[1][t, g] += d
        assert got == want


def test_divergence_against_a_plain_version(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["Ab", "ab", "été", "x" * 20, "x" * 21, "mot", "wort", "ÀB", "日本", "b"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) or None, rng.choice(["en", "fr", None, ""]),
             rng.choice(["a", "b", "c", None, "é"])) for _ in range(300)]
    rows += [("only two", "xx", "a"), ("only two", "xx", "b"), (None, "zz", None), ("7 !", "yy", "s"), (LONG, "en", "a")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    assert divergence_rows(D.divergence(docs)) == plain_divergence(rows)
    monkeypatch.setattr(D, "BLOCK_CELLS", 8)               # many blocks, tiles of one source
    monkeypatch.setattr(D, "TILE_CELLS", 1)
    assert divergence_rows(D.divergence(docs)) == plain_divergence(rows)


def test_divergence_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    assert divergence_rows(D.divergence(odd_docs)) == plain_divergence([(r[1], r[2], r[3]) for r in ROWS])
    assert D.divergence(no_docs).count() == 0


# --- 12: shards

def plain_lpt(sizes, shards):
    loads = [0] * shards
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return loads


def test_deal_is_the_heap_in_closed_form():
    rng = random.Random(1)
    for _ in range(300):
        k = rng.randint(1, 9)
        loads = [rng.choice([0, rng.randint(0, 50), rng.randint(0, 5000)]) for _ in range(k)]
        size, groups = rng.randint(0, 40), rng.randint(1, 400)
        slow, n = list(loads), [0] * k
        for _ in range(groups):
            i = slow.index(min(slow))
            slow[i] += size
            n[i] += 1
        fast = list(loads)
        assert S.deal(fast, size, groups) == n and fast == slow


def check_shards(rows, shards, out):
    """out: (text, shard, slot) rows. Groups whole, slots gapless, loads those of the plain schedule."""
    assert Counter(r[0] for r in out) == Counter(rows)
    groups, loads, slots = defaultdict(set), [0] * shards, defaultdict(list)
    sizes = Counter()
    for text in rows:
        sizes[text or ""] += len((text or "").encode()) + 1
    for text, shard, slot in out:
        groups[text or ""].add(shard)
        loads[shard] += len((text or "").encode()) + 1
        slots[shard].append(slot)
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(loads) == sorted(plain_lpt(sizes.values(), shards))


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_the_plain_schedule(spark, shards):
    rng = random.Random(shards)
    rows = [rng.choice(["é", "w"]) * rng.choice([0, 1, 2, 3, 3, 3, rng.randint(0, 60)]) for _ in range(700)]
    rows += ["hot text"] * 400 + [None, None, LONG] + [f"{i:05d}" for i in range(500)]      # copies, nulls, a large one, ties
    df = spark.createDataFrame([(i % 900, t) for i, t in enumerate(rows)], "doc_id int, text string").repartition(5)
    out = S.assign_shards(df, S.text_group(), S.text_size(), shards)
    check_shards(rows, shards, [(r.text, r.shard, r.slot) for r in out.collect()])
    again = S.assign_shards(df.repartition(3), S.text_group(), S.text_size(), shards)
    # a null and an empty text of one id are alike, so either may have the lower slot
    assert sorted((r.doc_id, r.text or "", r.shard, r.slot) for r in out.collect()) == sorted(
        (r.doc_id, r.text or "", r.shard, r.slot) for r in again.collect())


def test_shard_query_digests_and_balance(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = LLM_QUERIES["op12_sharding"](spark, SF).collect()
    text = {r.doc_id: r.text for r in docs}
    assert len(out) == len(docs)
    for r in out:
        b = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None)
    check_shards([r.text for r in docs], 8, [(text[r.doc_id], r.shard, r.slot) for r in out])


def test_shards_written_whole_and_in_order(spark, odd_docs, scratch):
    back = S.write_shards(odd_docs, f"{scratch}/shards", shards=3, rows_a_file=2)
    assert sorted(map(repr, (tuple(r[c] for c in SCHEMA_NAMES) for r in back.collect()))) == sorted(map(repr, ROWS))
    for r in back.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect():
        assert (r.a, r.b) == (0, r.n - 1)
    for r in back.groupBy(F.input_file_name()).agg(F.max("slot").alias("b"), F.min("slot").alias("a")).collect():
        assert r.b - r.a < 2


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_shards_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    out = S.assign_shards(odd_docs.withColumn("shard", F.lit("x")).withColumn("slot", F.lit(-1)), S.text_group(), S.text_size(), 4)
    assert set(out.columns) == set(odd_docs.columns) | {"shard", "slot"} and out.schema["shard"].dataType.typeName() == "integer"
    check_shards([r[1] for r in ROWS], 4, [(r.text, r.shard, r.slot) for r in out.collect()])
    assert S.shard_report(no_docs).count() == 0
    zero = S.assign_shards(odd_docs, F.col("text"), F.lit(None), 4).collect()
    assert {r.shard for r in zero} == {0} and len(zero) == len(ROWS)


# --- 13: vector codes

def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = [(i, l, [int(np.floor(scale * float(x))) for x in v]) for i, l, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    at = V.cuts(len(rows[0][2]), parts)
    cut = [[tuple(v[at[k]:at[k + 1]]) for k in range(parts)] for _, _, v in rows]
    books = [[cut[j][k] for j in range(min(entries, len(rows)))] for k in range(parts)]

    def near(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[k]))

    for _ in range(rounds):
        for k in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[near(k, c[k])[1]].append(c[k])
            books[k] = [tuple(sum(x) // len(mine[j]) for x in zip(*mine[j])) if j in mine else e for j, e in enumerate(books[k])]
    found = [[near(k, c[k]) for k in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    of = Counter()
    for (_, label, _), e in zip(rows, errors):
        of[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, l, "".join(f"{j:02x}" for _, j in f), e, of[l], sha) for (i, l, _), f, e in zip(rows, found, errors)), key=repr)


VECTORS = "vec_id bigint, embedding array<float>, label string"


def coded(df):
    return sorted(((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n,entries,spread", [(400, 16, 1.0), (400, 16, 0.01), (9, 16, 1.0), (300, 200, 3.0)])
def test_codes_against_a_plain_version(spark, n, entries, spread):
    rng = np.random.default_rng(n + entries)
    base = rng.normal(size=(5, 24)) * 0.2
    rows = [(int(rng.integers(0, n)), base[i % 5] + rng.normal(size=24) * 0.05 * spread, ["a", "b", None][i % 3]) for i in range(n)]
    rows = [(i, [float(np.float32(x)) for x in v], l) for i, v, l in rows]
    rows += [(None, rows[0][1], "a"), rows[1], rows[1], (n, None, "a"), (n, [float("nan")] * 24, "b"), (n, rows[2][1][:-1] + [None], "b"),
             (n, [float("inf")] * 24, "b")]
    df = spark.createDataFrame(rows, VECTORS).withColumn("error", F.lit("x")).repartition(5)
    assert coded(V.compress(df, entries=entries)) == plain_codes([(i, l, v) for i, v, l in rows], entries=entries)


def test_memo_keeps_every_nearest_entry_and_skips_some(monkeypatch):
    rng = np.random.default_rng(0)
    entries = rng.integers(-900, 900, (16, 8))
    parts = np.concatenate([rng.integers(-1000, 1000, (3000, 8)), np.repeat(entries, 50, axis=0), entries[[0, 0]] + [[1], [-1]]])
    gaps = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    for cells in (10, 1 << 18):                            # the memo starts anew again and again, or never
        monkeypatch.setattr(V, "MEMO_CELLS", cells)
        memo = V.Memo(entries)
        for i in range(0, len(parts), 500):
            entry, d = memo.nearest(parts[i:i + 500])
            assert (entry == gaps[i:i + 500].argmin(axis=1)).all() and (d == gaps[i:i + 500].min(axis=1)).all()
        assert memo.evaluated < 0.8 * gaps.size


def test_cells_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(V, "mix", lambda x: x % np.uint64(3))
    rng = np.random.default_rng(1)
    entries, parts = rng.integers(-900, 900, (16, 8)), rng.integers(-1000, 1000, (2000, 8))
    entry, _ = V.Memo(entries).nearest(parts)
    assert (entry == ((parts[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_codes_of_odd_vectors(spark, monkeypatch):
    v = [0.5] * 8
    df = spark.createDataFrame([(1, v, "a"), (2, [0.5] * 7, "a"), (3, [1e30] + v[1:], None), (4, None, None), (5, [], "b"), (6, v, None)], VECTORS)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in V.compress(df).collect()}
    assert got == {1: ("00" * 8, 0, 0), 2: (None, None, 0), 3: (None, None, 0), 5: (None, None, None), 6: ("00" * 8, 0, 0)}
    assert V.compress(df.where("vec_id = 5")).collect()[0].error == 0         # vectors without components
    assert V.compress(df.where("vec_id = 4")).count() == 0
    assert V.compress(df.limit(0)).count() == 0
    monkeypatch.setattr(V, "bounded", lambda df: (df, False))                 # labels joined by shuffling
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in V.compress(df).collect()} == got


def test_decode_gives_the_entries(spark):
    books = [np.array([[1, 2], [3, 4]]), np.array([[5], [6]])]
    out = V.decode(spark.createDataFrame([("0100",), ("0001",)], "code string"), books).collect()
    assert [r.approx for r in out] == [[3, 4, 5], [1, 2, 6]]
