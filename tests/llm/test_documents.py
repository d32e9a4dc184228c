"""Operators on documents: brute force on the small tables, and odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, langid, licenses, mixing, near_dedup, secrets, substring_dedup, toxicity
from docloom.llm.common import table
from docloom.llm.queries import LLM_QUERIES as Q
from tests.llm.conftest import CLEAN, LONG, ROWS
from tests.llm.test_words import WORD, fold

SF = "/root/testdata/sf0.001"
N = len(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in table(spark, SF, "documents").collect()}


def words(t):
    return WORD.findall(fold(t or ""))


# ---------------------------------------------------------------- toxicity
def test_toxicity_learns_marked_words_and_holds_out(spark, odd_docs, no_docs, no_labels):
    rows = [(i, f"plain text number {i % 9} about rivers and {'vile' if i % 3 == 0 else 'kind'} people") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    out = toxicity.score_documents(docs, labels, l1=1.0).collect()
    assert len(out) == 600 and any(r.held_out for r in out)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all(r.predicted == int(r.score >= 0.3) == int(r.doc_id % 3 == 0) for r in out)
    assert toxicity.without_toxic(docs, labels, l1=1.0).count() == 400
    nothing = toxicity.score_documents(odd_docs, no_labels).collect()
    assert len(nothing) == N and {r.score for r in nothing} == {0.0}
    assert toxicity.score_documents(no_docs, no_labels).count() == 0


def test_toxicity_state_is_a_row_a_block_and_fits_as_one_process(spark, monkeypatch):
    """The tables between shards hold blocks of coordinates, not a row a coordinate, and the weights are FTRL's."""
    made, bits = [], 16
    real = toxicity.stage
    monkeypatch.setattr(toxicity, "stage", lambda df, name: made.append((name, real(df, name))) or made[-1][1])
    rows = [(i, f"text {i % 9} of {'vile' if i % 3 == 0 else 'kind'} people " + " ".join(f"w{i * k % 701}" for k in range(40)),
             int(i % 3 == 0)) for i in range(240)]
    got = toxicity.fit(spark.createDataFrame(rows, "id bigint, text string, y int").repartition(5), "id", "text", "y", bits=bits, l1=0.5)
    states = [df for name, df in made if name == "ftrl-state"]
    assert len(states) == 8 and all(0 < df.count() <= (1 << bits) // toxicity.BLOCK + 1 for df in states)
    dims = (1 << bits) + 1
    model = toxicity.Ftrl(np.zeros(dims), np.zeros(dims), 0.2, 1.0, 0.5, 1.0)
    docs = next(df for name, df in made if name == "toxicity-fit").orderBy("turn").collect()
    assert len(docs) == 240
    for turn in range(8):
        mine = [r for r in docs if r.shard == turn % 4]
        seen = Counter(c for r in mine for c in r.x)
        for r in mine:
            model.learn(np.array([c for c in r.x if seen[c] > 1] + [dims - 1]), float(r.y))
    at = np.flatnonzero(np.abs(model.z) > 0.5)
    assert len(at) and got["at"].tolist() == at.tolist() and np.array_equal(got["weight"], model.weights()[at])


def test_ftrl_step_is_the_published_update():
    m = toxicity.Ftrl(np.zeros(3), np.zeros(3), alpha=0.5, beta=1.0, l1=0.1, l2=0.0)
    m.learn(np.array([0, 2]), 1.0)
    assert np.allclose(m.z, [-0.5, 0, -0.5]) and np.allclose(m.n, [0.25, 0, 0.25])
    assert np.allclose(m.weights(), [0.4 / ((1 + 0.5) / 0.5), 0, 0.4 / 3])


# ---------------------------------------------------------------- secrets
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    sp = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    sp += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    sp += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(sp)


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


TRICKY = ["token=short token: longenough1 API_KEY='abcdefgh' x", "secret\"=\"" + "a" * 40, "AKIA" + "B" * 11 + " AKIA" + "C" * 12 + "d",
          "é\x01\x01 passwd = éé password = \x01\x01abcdefghij", "f" * 31 + " " + "0" * 32 + "g" + "1" * 33, "tokentoken:::=abcdefgh token= token=12345678",
          "apikey:x.y-z_/+=1 APIkey : 0123456789abcdef0123456789abcdef"]


def test_base_secrets_equal_a_plain_scan(spark, docs):
    some = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id bigint, text string")
    texts = dict(enumerate(TRICKY))
    for r in secrets.secrets(some).collect():
        want = base_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3)), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(line(want).encode()).hexdigest()
        assert r.spans == line(want)
    for r in Q["op2_secret_scan"](spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(line(base_spans(docs[r.doc_id].text)).encode()).hexdigest()


#: Token kinds: alphabet and length (32 digits or more are a base span of kind hex).
TOKENS = {"base64": (secrets.SYMBOLS[:64], 44), "lower": (secrets.LOWER, 40), "upper": (secrets.LOWER.upper(), 40), "digits": (secrets.DIGITS, 30),
          "base32": (secrets.ALPHABETS["base32"], 32), "base32 long": (secrets.ALPHABETS["base32"], 52), "lower36": (secrets.ALPHABETS["lower36"], 32),
          "HEX": (secrets.ALPHABETS["HEX"], 40)}


def test_battery_finds_random_tokens_of_every_kind_and_leaves_ordinary_ones(spark):
    rng = np.random.default_rng(1)
    words = "configuration manager instance server alpha delta network session production backup storage client region status report".split()
    plain = ["_".join(rng.choice(words, 4)) for _ in range(150)] + ["-".join(rng.choice(words, 4)) for _ in range(150)] + [
        "".join(rng.choice(words, 4)) for _ in range(97)] + ["x" * 60, "xyxy" * 12, "ABCDEFGHIJ" * 5]
    plain = [p for p in plain if len(p) >= 20]
    random_ = [(k, "".join(rng.choice(list(a), n))) for k, (a, n) in TOKENS.items() for _ in range(20)]
    rows = [(i, f"see {t} here") for i, (_, t) in enumerate(random_)] + [(1000 + i, f"see {t} here") for i, t in enumerate(plain)]
    out = {r.doc_id: r.spans for r in secrets.secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = {k: sum(out[i] == f"random:4:{4 + len(t)}" for i, (of, t) in enumerate(random_) if of == k) for k in TOKENS}
    assert all(n >= 18 for n in found.values()), found
    assert all(out[1000 + i] == "" for i in range(len(plain)))


def test_battery_values_against_a_plain_version(spark):
    rng = np.random.default_rng(4)
    tokens = ["".join(rng.choice(list(a), n)) for a, n in TOKENS.values() for _ in range(5)] + ["a" * 25, "ab" * 15, "the_quick_brown_fox_jumps"]
    docs = spark.createDataFrame([(t,) for t in tokens] + [("the quick brown fox",), (None,)], "text string")
    chain = secrets.ordinary_chain(secrets.vocabulary(docs))
    wide = len(secrets.SYMBOLS)
    pair, row, one = chain
    assert len(pair) == wide * wide and len(row) == len(one) == wide and abs(sum(one) - 1) < 1e-9
    text = " ".join([*tokens, "the quick brown fox"])
    pairs = Counter(w[i:i + 2] for w in text.split() for i in range(len(w) - 1))
    assert {a + b: pair[i * wide + j] for i, a in enumerate(secrets.SYMBOLS) for j, b in enumerate(secrets.SYMBOLS) if pair[i * wide + j]} == pairs
    own = {t: i % 2 for i, t in enumerate(tokens)}
    got = {r.m: r for r in secrets.battery(spark.createDataFrame(list(own.items()), "m string, own bigint"), chain).collect()}
    for t in tokens:
        kind = next(k for k, a in secrets.ALPHABETS.items() if set(t) <= set(a))
        size, n = secrets.SIZES[kind], len(t)
        x = np.array([min(secrets.ALPHABETS[kind].index(c), size - 1) for c in t], float)
        bins = next((d for d in range(size, 1, -1) if size % d == 0 and n >= 5 * d), 2)
        e = n / bins
        chi = ((np.bincount(x.astype(int) % bins, minlength=bins) - e) ** 2 / e).sum()
        z_chi = ((chi / (bins - 1)) ** (1 / 3) - (1 - 2 / (9 * (bins - 1)))) / np.sqrt(2 / (9 * (bins - 1)))
        high = x >= size / 2
        n1, runs = high.sum(), 1 + (high[1:] != high[:-1]).sum()
        even = 2 * n1 * (n - n1) / n
        z_runs = (runs - even - 1) / np.sqrt(max(even * (even - 1) / (n - 1), 1e-9)) if 0 < n1 < n else 99.0
        d = x - x.mean()
        z_serial = (d[1:] * d[:-1]).sum() / (d * d).sum() * np.sqrt(n) if d.any() else 99.0
        s = [secrets.SYMBOLS.index(c) for c in t]
        two, alone, none = secrets.CHAIN
        bits = -n * np.log2(size) - np.log2(one[s[0]])
        for a, b in zip(s, s[1:]):
            after = row[a] - own[t]
            bits -= np.log2(two * max(pair[a * wide + b] - own[t], 0) / max(after, 1) + (alone + (after <= 0) * two) * one[b] + none / wide)
        r = got[t]
        assert (r.encoding, r.length) == (kind, n)
        assert np.allclose([r.z_chi, r.z_runs, r.z_serial, r.nlp], [z_chi, z_runs, z_serial, max(bits, 0) * np.log10(2)], atol=1e-6), t


def test_secrets_odd_rows_and_redaction(odd_docs, no_docs):
    out = secrets.secrets(odd_docs).collect()
    assert len(out) == N and sum(r.n_assign for r in out) == 1
    assert [r.spans for r in out if r.n_assign] == ["assign:10:29"]
    red = secrets.redact(odd_docs, length_col="n_chars")
    assert red.columns == odd_docs.columns
    got = {(r.doc_id, r.text, r.n_chars, r._rk) for r in red.collect() if r.doc_id == 8}
    assert got == {(8, "é\x01ü ñandú [SECRET] tail", 23, "extra _rk")}
    assert red.where("text is null").count() == 2 and red.count() == N
    assert secrets.secrets(no_docs).count() == 0 and secrets.redact(no_docs).count() == 0


# ---------------------------------------------------------------- mixing
def test_mix_meets_targets(spark, docs, odd_docs, no_docs):
    out = Q["op3_source_mixing"](spark, SF).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    total = {}
    for i, d in docs.items():
        total[d.source] = total.get(d.source, 0) + size[i]
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, level = set(), 0
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * level > 2 * total[s]}
        if not more:
            break
        capped |= more
    taken = {}
    for r in out:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(2 * total[s] if s in capped else weight[s] * level)
        taken[s] = taken.get(s, 0) + r.taken
    for s in order:
        largest = max(size[i] for i, d in docs.items() if d.source == s)
        assert abs(taken[s] - min(2 * total[s], weight[s] * level)) <= largest / 2 + 1
    again = Q["op3_source_mixing"](spark, SF).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    odd = mixing.mix(odd_docs).collect()
    assert len(odd) == N and all(r.taken <= 2 * r.size for r in odd) and sum(r.size == 0 for r in odd) == 3
    assert mixing.mix(no_docs).count() == 0


# ---------------------------------------------------------------- licenses
def test_license_base_equals_a_plain_scan(spark, docs, odd_docs, no_docs):
    for r in Q["op4_license_scan"](spark, SF).collect():
        w, at, labels = words(docs[r.doc_id].text), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    at.append(i)
                    labels.add(label)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(filter(None, r.labels.split(",")))
    out = licenses.license_scan(odd_docs).collect()
    assert len(out) == N and {r.labels for r in out} == {""}
    assert licenses.license_scan(no_docs).count() == 0


def test_license_votes_find_altered_templates(spark):
    mit = dict(licenses.TEMPLATES)["mit-text"]
    w = mit.split()
    altered = " ".join(w[:20] + ["EXTRA", "WORDS"] + w[20:40] + w[41:])
    rows = [(1, "intro " * 50 + mit + " outro"), (2, "pre " + altered), (3, " ".join(w[:12])), (4, " ".join(sorted(w))), (5, mit + " gap " * 90 + mit)]
    out = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1].labels == out[2].labels == out[5].labels == "mit-text" and out[3].labels == out[4].labels == ""
    assert out[1].spans == f"mit-text:50:{50 + len(words(mit))}" and out[5].spans.count("mit-text") == 2
    assert out[1].score == 1.0 and 0.75 <= out[2].score < 1


# ---------------------------------------------------------------- near duplicates
def classes(texts, t=0.8):
    sets = []
    for x in texts:
        w = words(x)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and k >= t * (len(sets[i]) + len(sets[j]) - k) - 1e-9:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force_on_dense_groups(spark):
    rng = np.random.default_rng(5)
    base = [[f"v{x}" for x in rng.integers(0, 400, 120)] for _ in range(3)]
    texts = []
    for b in base:
        for _ in range(60):                                # some pairs of a group reach the threshold, some don't
            t = list(b)
            for p in rng.integers(0, 120, rng.integers(0, 5)):
                t[p] = f"z{rng.integers(0, 10 ** 6)}"
            texts.append(" ".join(t))
    texts += [texts[0], texts[0].upper(), "a b", "a b", "a c", None, "", "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    out = near_dedup.near_duplicates(odd_docs)
    got = sorted(map(tuple, out.select("doc_id", "class_id").collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (None, None)], key=repr)
    left = near_dedup.without_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert kept == sorted([(1, CLEAN), (3, None), (4, ""), (5, ROWS[6][1]), (6, "one"), (7, LONG), (8, ROWS[9][1]), (None, None)], key=repr)
    assert near_dedup.near_duplicates(no_docs).count() == 0


# ---------------------------------------------------------------- language
def test_language_mixture(spark, docs, odd_docs, no_docs):
    out = Q["op6_language_id"](spark, SF).collect()
    held = [r for r in out if r.held_out]
    assert held and np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in out)
    en, de = ("the river and the people of the old town were there with us " * 4), ("der fluss und die leute der alten stadt waren dort mit uns ich nicht " * 4)
    rows = [(i, en, "en") for i in range(30)] + [(i, de, "de") for i in range(30, 60)] + [(100, en + de, None), (101, "12 34", None), (102, None, "en")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit(1))
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert got[0].lang_pred == "en" and got[40].lang_pred == "de" and got[0].n_langs == 1 and got[100].n_langs == 2
    assert got[101].lang_pred == got[102].lang_pred == "und" and got[101].score == 0
    assert langid.identify(odd_docs).count() == N and langid.identify(no_docs).count() == 0


def test_texts_of_many_languages_and_tables_of_many(spark):
    rng = np.random.default_rng(11)
    own = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for k in range(7)}
    rows = [(i, " ".join(rng.choice(own[f"l{i % 7}"], 120)), f"l{i % 7}") for i in range(350)]
    mixed = " ".join(w for k in range(6) for w in rng.choice(own[f"l{k}"], 160))
    d = spark.createDataFrame([*rows, (1000, mixed, None), (1001, " ".join(rng.choice(own["l6"], 80)), None)], "doc_id bigint, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(d).collect()}
    assert out[1000].n_langs == 6 and out[1001].n_langs == 1 and out[1001].lang_pred == "l6"
    many = spark.createDataFrame([(i, f"{'abcdefgh'[i % 8]}word{i} text{i * 7}", f"lang{i:04d}") for i in range(1300)], "doc_id bigint, text string, lang string")
    got = langid.identify(many).collect()
    assert len(got) == 1300 and all(r.lang_pred.startswith("lang") and 0 <= r.score <= 1 for r in got)


# ---------------------------------------------------------------- repeated lines
def test_repeated_lines_odd_rows_and_round_trip(spark, odd_docs, no_docs):
    long_line = "this line has more than eight words in it for sure"
    d = spark.createDataFrame([(2, f"x\n{long_line}\nü end"), (1, f"{long_line.upper()}!\nown words here"), (None, long_line),
                               (3, f"{long_line}\n{long_line}")], "doc_id bigint, text string").withColumn("start", F.lit(0))
    out = {r.doc_id: r for r in substring_dedup.report(d, unit="line", least=1).collect()}
    n = len(long_line)
    assert out[1].spans == "" and out[2].spans == f"2:{2 + n}" and out[3].spans == f"0:{2 * n + 1}" and out[None].spans == f"0:{n}"
    cut = {r.doc_id: r for r in substring_dedup.without_repeats(d, unit="line", least=1).collect()}
    assert cut[2].text == "x\n\nü end" and cut[3].text == "" and cut[2].start == 0
    odd = substring_dedup.report(odd_docs, least=10).collect()
    assert len(odd) == N and sum(r.n_removed for r in odd) == 3        # four rows of one line: one stays
    assert substring_dedup.report(no_docs).count() == 0
    pars = substring_dedup.report(spark.createDataFrame(
        [(1, f"a b\n{long_line}\n\n{long_line}"), (2, f"{long_line}\n \nz")], "doc_id bigint, text string"), unit="paragraph", least=1).collect()
    assert {r.doc_id: r.n_removed for r in pars} == {1: 0, 2: 1}


def test_passages_inside_lines_are_found_and_short_repetitions_stay(spark):
    rng = np.random.default_rng(9)
    some = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 10 ** 9, n))
    passage = ". ".join(some(14) for _ in range(4)) + "."
    rows = [(i, f"{some(30)}, {passage} {some(20)}\n{some(12)}") for i in range(5)] + [(9, f"common line of seven words stays here\n{some(40)}") for _ in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r for r in substring_dedup.report(df.where("doc_id < 9")).collect()}
    assert out[0].n_removed == 0 and all(out[i].n_removed == 1 for i in range(1, 5))
    text = dict(rows)
    for i in range(1, 5):
        a, b = map(int, out[i].spans.split(":"))
        assert text[i][a:b].strip() == passage[passage.index(". ") + 2:]
    assert sum(r.n_removed for r in substring_dedup.report(df.where("doc_id = 9")).collect()) == 0


# ---------------------------------------------------------------- benchmark
def test_contamination_equals_whole_item_search(spark, docs, odd_docs, no_docs):
    items = {r.item_id: words(r.text) for r in table(spark, SF, "benchmark").collect()}
    for r in Q["op10_decontamination"](spark, SF).collect():
        t = " " + " ".join(words(docs[r.doc_id].text)) + " "
        assert {i for i, w in items.items() if " " + " ".join(w) + " " in t} <= set(map(int, filter(None, r.items.split(","))))
        assert r.contaminated == bool(r.items) and r.n_words == len(words(docs[r.doc_id].text))
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog while seven wise owls watch"), (2, None), (3, "too short"),
                                   (4, "seven wise owls watch from the old"), (5, "w5x1 nothing else of it stands anywhere in any text here now"), (6, "The lazy dog"), (7, "dog the lazy"),
                                   (8, "one"), (9, "...")],
                                  "item_id bigint, text string")
    out = decontaminate.contamination(odd_docs, bench).collect()
    assert sorted(r["items"] for r in out if r.contaminated) == ["1,4,6"] * 4 + ["8"] and len(out) == N        # short items whole and exactly
    assert decontaminate.contamination(odd_docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(no_docs, bench).count() == 0
    left = decontaminate.without_contaminated(odd_docs, bench)
    assert left.columns == odd_docs.columns and left.count() == N - 5


def test_contamination_tolerates_substitutions_and_joins_by_shuffle_alike(spark):
    rng = np.random.default_rng(2)
    item = [f"q{i}" for i in range(30)]
    rows = []
    for i in range(40):
        t = list(item)
        for p in rng.choice(30, 4, replace=False):
            t[p] = "other"
        rows.append((i, " ".join(["pad"] * i + t + ["end"])))
    rows += [(100 + i, " ".join(rng.permutation(item))) for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = sorted(map(tuple, decontaminate.contamination(d, b).collect()))
    assert [r[2] for r in got] == [True] * 40 + [False] * 10
    assert got == sorted(map(tuple, decontaminate.contamination(d, b, most_rows=0).collect()))


def test_a_phrase_of_many_items_and_texts(spark):
    """An opening that all items share and many texts hold: only texts with an item's own words are contaminated."""
    rng = np.random.default_rng(6)
    some = lambda n: [f"y{x}" for x in rng.integers(0, 10 ** 9, n)]
    opening = "which of the following statements is".split()
    items = [opening + some(14) for _ in range(400)]
    texts = [some(40) + opening + some(300) for _ in range(100)] + [some(20) + items[i] + some(5) for i in range(3)]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    for most in (decontaminate.MOST_ROWS, 0):
        got = {r.doc_id: r["items"] for r in decontaminate.contamination(d, b, most_rows=most).collect()}
        assert got == {**{i: "" for i in range(100)}, **{100 + i: str(i) for i in range(3)}}


def test_every_run_that_verifies_keeps_the_positions_of_a_mask():
    from itertools import combinations
    masks = {sum(1 << x for x in m) for m in decontaminate.MASKS}
    for n in range(decontaminate.SHORT, 20):      # a longer run holds a shorter one: of its halves one has the share
        for inner in combinations(range(1, n - 1), max(decontaminate.SHORT, -(-3 * n // 5)) - 2):
            at = (0, *inner, n - 1)
            if max(b - a for a, b in zip(at, at[1:])) <= decontaminate.GAP:
                bits = sum(1 << x for x in at)
                assert any(bits >> i & m == m for m in masks for i in range(n)), at


def test_contamination_equals_verifying_every_diagonal(spark):
    rng = np.random.default_rng(4)
    some = lambda n: [f"z{x}" for x in rng.integers(0, 10 ** 9, n)]
    items = {1: some(22), 2: some(200), 3: some(15), 4: some(9)}
    texts = [items[1][:11] + items[1][12:], items[1][:11] + ["new"] + items[1][11:]]       # a word left out, one put in
    texts += [[w if (i + k) % 4 else "new" for i, w in enumerate(items[2])] for k in range(4)]
    for i in range(200):                          # random words replaced
        t = list(items[1 + i % 4])
        for p in rng.choice(len(t), len(t) * (1 + i % 5) // 10 + 1, replace=False):
            t[p] = "new"
        texts.append(t)
    texts = [some(5) + t + some(5) for t in texts]
    code = {w: i for i, w in enumerate({w for t in [*texts, *items.values()] for w in t})}
    num = lambda ws: np.array([code[w] for w in ws])

    def judged(t, it):
        cover = sum(decontaminate.runs(num(t), num(it), d, 6, 0.6) for d in range(-len(it), len(t))) > 0
        return cover.sum() >= 13 or cover.sum() >= 0.6 * len(it)

    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.contamination(d, b).collect()}
    assert got == {i: ",".join(str(k) for k, it in items.items() if judged(t, it)) for i, t in enumerate(texts)}
    assert all(got[i] for i in range(6))


# ---------------------------------------------------------------- near duplicates of unequal counts
def test_a_text_and_its_repetitions_are_one_class(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        t = " ".join(f"v{x}" for x in rng.integers(0, 10 ** 9, 60))
        rows += [(10 * i, t)] + [(10 * i + k, " ".join([t] * n)) for k, n in enumerate((16, 64, 256), 1)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.class_id == r.doc_id // 10 * 10 for r in out)
    alone = [r for r in rows if r[0] % 10 in (0, 2)]                # no text of a middle count between the two
    out = near_dedup.near_duplicates(spark.createDataFrame(alone, "doc_id bigint, text string")).collect()
    assert all(r.class_id == r.doc_id // 10 * 10 for r in out)
