"""Secrets in texts: fixed patterns, and tokens that a battery of randomness
tests can't tell from random strings. All of it is DataFrame functions.

Base spans are the leftmost non-overlapping matches of three patterns (kinds
assign, access, hex) that are long enough. The method adds spans of kind
``random``: for every maximal run of 20 or more characters of
``[A-Za-z0-9+/_=-]`` that no base span overlaps,

* the encoding is inferred: the smallest of the alphabets below that holds the
  run, which gives each character its place;
* three tests ask if the run could be uniform over the alphabet: chi-squared
  over as many equal classes of the alphabet as the length allows, runs above
  and below the alphabet's middle, and the serial correlation of neighbours;
* a run that passes all three is a discovery only if it is unlikely as an
  ordinary token. Ordinary tokens are a chain of characters whose pair counts
  are taken over all words of all texts but the secrets found. The likelihood ratio of the inferred
  encoding's uniform characters against that chain is at least r for an
  ordinary token with a probability of at most 1 / r, so 1 / r is its p-value
  (never too small if the chain holds), and it has to fall under the
  Benjamini-Hochberg threshold of the run's length class. P-values are counted
  over the whole input on a fixed grid, so no task sees all of them.

Spans are [start, end) in code points.

Cases: null and empty texts have no spans; U+0001 in a text counts as one
character like others; equal rows are scanned once and each gets the answer;
rows of a null id too; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_ROWS, row_key, stage

# The base patterns, and the runs that the battery tests.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
RUN = r"((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,})"
# What a text has to match for a kind to leave a span at all, and the forms used to mark spans: hex and access runs are
# maximal, so a run that is too short is never part of a longer match and needn't be marked.
MARKED = {"assign": ASSIGN, "access": r"(AKIA[A-Z0-9]{12,})", "hex": r"((?<![0-9a-f])[0-9a-f]{32,})", "random": RUN}
KINDS = ("assign", "access", "hex", "random")
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets of the encodings, smallest first; base 64's variants of its last two symbols and its padding share a place.
ALPHABETS = {"digits": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "lower": LOWER, "upper": LOWER.upper(),
             "base32": LOWER.upper() + "234567", "lower36": DIGITS + LOWER, "upper36": DIGITS + LOWER.upper(),
             "base64": LOWER.upper() + LOWER + DIGITS + "+/_=-"}
SIZES = {k: min(len(a), 64) for k, a in ALPHABETS.items()}
SYMBOLS = ALPHABETS["base64"]

#: Level of the three tests; false-discovery rate; weights of pairs, single characters and none in an ordinary token's chain.
Z_LIMIT, FDR = 3.3, 0.01
CHAIN = (0.7, 0.2, 0.1)


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut before and after every match: at even places what stands
    between matches, at odd places the matches; (place, length, match)."""
    marked = F.regexp_replace(F.translate(text, "\x01", "\x02"), pattern, "\x01$1\x01")
    return F.transform(F.split(marked, "\x01", -1), lambda x, i: F.struct(
        i.alias("i"), F.char_length(x).alias("n"), F.when(i % 2 == 1, x).alias("m")))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rk, and for each kind the pieces, null where the text has no match)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"),
                       *[F.when(text.rlike(MARKED[k]), _pieces(text, MARKED[k])).alias(k) for k in KINDS])


def _spans(scanned: DataFrame) -> DataFrame:
    """(rk, kind, rank, start, end, m) of all matches that are long enough."""
    some = scanned.where(F.coalesce(*KINDS).isNotNull()).dropDuplicates(["rk"])
    pieces = some.select("rk", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(k).alias("p"))
                                                   for i, k in enumerate(KINDS)])).alias("k")).select("rk", "k.*")
    pieces = pieces.select("rk", "rank", "kind", F.explode("p").alias("p")).select("rk", "rank", "kind", "p.*")
    w = Window.partitionBy("rk", "rank").orderBy("i")       # the matches of one text
    placed = pieces.withColumn("end", F.sum("n").over(w)).withColumn("start", F.col("end") - F.col("n")).where("m is not null")
    # 'drop failing matches': a match of assign counts if its value has eight characters
    long_enough = (F.col("kind") != "assign") | (F.char_length(F.regexp_extract("m", "^" + ASSIGN, 2)) >= 8)
    return placed.where(long_enough).select("rk", "kind", "rank", "start", "end", "m")


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, n): the words of all texts, runs of two or more of the battery's characters, and how often they stand there."""
    return docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "[^A-Za-z0-9+/_=-]+")).alias("w")).where(
        F.length("w") > 1).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def ordinary_chain(words: DataFrame) -> tuple[list[int], list[int], list[float]]:
    """How often each symbol stands after each other one in ``words`` (w, n)
    (the earlier symbol's row first), how often each is followed by another,
    and the probability of each by itself."""
    pairs = words.select("n", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i"), "w").select(
        F.expr("substring(w, i, 2)").alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).collect()     # at most 67 x 67 rows
    size = len(SYMBOLS)
    place = {c: i for i, c in enumerate(SYMBOLS)}
    count = [0] * (size * size)
    for r in pairs:
        count[place[r["p"][0]] * size + place[r["p"][1]]] = r["n"]
    single = [sum(count[b::size]) + 1 for b in range(size)]
    return count, [sum(count[i:i + size]) for i in range(0, size * size, size)], [x / sum(single) for x in single]


def random_tokens(tokens: DataFrame, words: DataFrame, secret: DataFrame) -> DataFrame:
    """The discoveries among ``tokens``. The chain is taken over ``words``
    without those known to be ``secret`` (w), then again without what has been
    discovered, while that finds more: random tokens must not teach the chain,
    and a token is judged without its own occurrences."""
    known, n = secret, 0
    while True:
        taught = words.join(known, "w", "left_anti")
        own = tokens.join(taught.select(F.col("w").alias("m"), F.col("n").alias("own")), "m", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        found = stage(discoveries(stage(battery(own, ordinary_chain(taught)), "tested")), "discovered")
        now = found.count()
        if now <= n:
            return found
        known, n = secret.unionByName(found.select(F.col("m").alias("w"))).distinct(), now


def battery(tokens: DataFrame, chain: tuple[list[int], list[int], list[float]], token: str = "m") -> DataFrame:
    """For tokens (``token``, and ``own``: how often it is among the chain's
    words) adds ``encoding``, the z-values of the three tests (``z_chi``,
    ``z_runs``, ``z_serial``), ``passes``, and ``nlp`` (minus log10 of the
    p-value as an ordinary token)."""
    t = F.col(token)
    kind = F.coalesce(*[F.when(t.rlike("^[" + a + "]+$"), F.lit(k)) for k, a in ALPHABETS.items() if k != "base64"], F.lit("base64"))
    alphabet = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    n = F.col("_n").cast("double")
    size = F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv])[F.col("encoding")]
    place = lambda c: F.least(F.instr(F.col("_alphabet"), c) - 1, F.col("_size") - 1)
    divisors = {s: [d for d in range(s, 1, -1) if s % d == 0] for s in sorted(set(SIZES.values()))}
    bins = F.coalesce(*[F.when((F.col("_size") == s) & (F.col("_n") >= 5 * d), d) for s, ds in divisors.items() for d in ds],
                      F.lit(2))
    df = (tokens.withColumn("encoding", kind).withColumn("_n", F.char_length(t)).withColumn("_size", size)
          .withColumn("_alphabet", alphabet[F.col("encoding")]).withColumn("_bins", bins)
          .withColumn("_c", F.split(t, "")).withColumn("_x", F.transform("_c", place)))
    e = n / F.col("_bins")
    chi = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("_bins") - 1),
                                  lambda b: F.size(F.filter("_x", lambda x: x % F.col("_bins") == b))),
                      F.lit(0.0), lambda a, c: a + (c - e) * (c - e) / e)
    free = (F.col("_bins") - 1).cast("double")
    z_chi = (F.pow(chi / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    pairs = F.arrays_zip(F.slice("_x", F.lit(1), F.col("_n") - 1).alias("a"), F.slice("_x", F.lit(2), F.col("_n") - 1).alias("b"))
    df = df.withColumn("z_chi", z_chi).withColumn("_pairs", pairs)
    half = F.col("_size") / 2
    n1 = F.size(F.filter("_x", lambda x: x >= half)).cast("double")
    n2 = n - n1
    runs = 1.0 + F.size(F.filter("_pairs", lambda p: (p["a"] >= half) != (p["b"] >= half)))
    even = 2 * n1 * n2 / n
    z_runs = F.when((n1 > 0) & (n2 > 0) & (n > 2), (runs - even - 1) / F.sqrt(F.greatest(even * (even - 1) / (n - 1), F.lit(1e-9)))
                    ).otherwise(F.lit(99.0))
    mean = F.aggregate("_x", F.lit(0.0), lambda a, x: a + x) / n
    df = df.withColumn("z_runs", z_runs).withColumn("_mean", mean)
    var = F.aggregate("_x", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    cov = F.aggregate("_pairs", F.lit(0.0), lambda a, p: a + (p["a"] - F.col("_mean")) * (p["b"] - F.col("_mean")))
    df = df.withColumn("z_serial", F.when(var > 0, cov / var * F.sqrt(n)).otherwise(F.lit(99.0)))
    # the likelihood ratio: uniform characters of the encoding against the chain of ordinary ones
    (pair, row, one), wide, (two, alone, none) = (F.lit(c) for c in chain), len(SYMBOLS), CHAIN
    df = df.withColumn("_s", F.transform("_c", lambda c: F.instr(F.lit(SYMBOLS), c) - 1))
    steps = F.arrays_zip(F.slice("_s", F.lit(1), F.col("_n") - 1).alias("a"), F.slice("_s", F.lit(2), F.col("_n") - 1).alias("b"),
                         F.array_repeat(F.col("own"), F.col("_n") - 1).alias("own"))

    def log_chance(p):
        after, seen = F.get(row, p["a"]) - p["own"], F.get(pair, p["a"] * wide + p["b"]) - p["own"]
        return F.log2(two * F.greatest(seen, F.lit(0)) / F.greatest(after, F.lit(1)) + F.when(after > 0, alone).otherwise(alone + two)
                      * F.get(one, p["b"]) + none / wide)

    ordinary = F.aggregate(steps, F.lit(0.0), lambda x, p: x + log_chance(p)) + F.log2(F.get(one, F.get("_s", 0)))
    bits = -n * F.log2(F.col("_size").cast("double")) - ordinary
    nlp = F.greatest(bits, F.lit(0.0)) * math.log10(2)
    passes = (F.col("z_chi") < Z_LIMIT) & (F.abs("z_runs") < Z_LIMIT) & (F.abs("z_serial") < Z_LIMIT)
    return df.withColumn("nlp", nlp).withColumn("passes", passes).drop(
        "_size", "_alphabet", "_bins", "_c", "_x", "_pairs", "_mean", "_s").withColumnRenamed("_n", "length")


def discoveries(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """The rows that pass the battery and whose p-value is under the
    Benjamini-Hochberg threshold of their length class (20-31, 32-47, 48-95,
    96 and more characters), taken over all rows."""
    stratum = F.when(F.col("length") < 32, 0).when(F.col("length") < 48, 1).when(F.col("length") < 96, 2).otherwise(3)
    t = tested.withColumn("stratum", stratum).withColumn("bin", F.floor(F.least(F.col("nlp"), F.lit(300.0)) * 20).cast("int"))
    grid = t.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))          # at most 4 x 6,001 rows
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    cut = (grid.withColumn("k", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("stratum")))
           .where(-F.col("bin") / 20 <= F.log10(F.lit(fdr) * F.col("k") / F.col("m"))).groupBy("stratum").agg(F.min("bin").alias("cut")))
    return t.join(F.broadcast(cut), "stratum").where("bin >= cut and passes")      # at most 4 rows


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables. One row per row of ``docs``: (rk, id); equal rows share rk.
    One row per rk with spans: (rk, spans), an array of (start, rank, kind,
    end) in order of start, then kind."""
    scanned = stage(scan(docs, id_col, text_col), "scanned")
    found = stage(_spans(scanned), "matches")
    base = found.where("rank < 3").groupBy("rk").agg(F.collect_list(F.struct("start", "end")).alias("base"))
    over = F.exists(F.coalesce("base", F.array()), lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    runs = stage(found.where("rank = 3").join(base, "rk", "left").withColumn("over", over).drop("base"), "runs")
    spans = found.where("rank < 3").select("rk", "start", "rank", "kind", "end")
    tokens = runs.where("not over")
    if not tokens.isEmpty():                                # else there is nothing to tell from ordinary tokens
        words = stage(vocabulary(docs, text_col), "vocabulary")
        secret = runs.where("over").select(F.col("m").alias("w")).distinct()
        spans = spans.unionByName(random_tokens(tokens, words, secret).select("rk", "start", "rank", "kind", "end"))
    per = stage(spans.groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans")),
                "spans")                                                          # the spans of one text
    return scanned.select("rk", "id"), per


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows, per = find_secrets(docs, id_col, text_col)
    all_ = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    count = lambda k: F.size(F.filter(all_, lambda s: s["kind"] == k)).cast("long")
    return rows.join(per, "rk", "left").select(
        F.col("id").alias(id_col), *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_line(F.filter(all_, lambda s: s["rank"] < 3)), 256).alias("base_sha256"), _line(all_).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
           mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span's text replaced by ``mark`` (overlapping spans
    by one); all columns and rows stay. ``length_col`` is set to the new
    length in code points where a text changed."""
    _, per = find_secrets(docs, id_col, text_col)
    n = per.agg(F.sum(F.size("spans")).alias("n")).first()["n"] or 0
    per = F.broadcast(per) if n <= BROADCAST_ROWS else per
    joined = docs.withColumn("_docloom_rk", row_key(id_col, text_col)).join(
        per.select(F.col("rk").alias("_docloom_rk"), F.col("spans").alias("_docloom_spans")), "_docloom_rk", "left")
    merged = F.aggregate("_docloom_spans", F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda a, s: F.when(
        (F.size(a) > 0) & (s["start"] < F.element_at(a, -1)["end"]),
        F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(
            F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))))).otherwise(
        F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    joined = joined.withColumn("_docloom_m", merged)
    kept = F.transform(F.sequence(F.lit(0), F.size("_docloom_m")), lambda i: F.substring(
        F.col(text_col), (F.coalesce(F.get("_docloom_m", i - 1)["end"], F.lit(0)) + 1).cast("int"),
        F.coalesce(F.get("_docloom_m", i)["start"] - F.coalesce(F.get("_docloom_m", i - 1)["end"], F.lit(0)), F.lit(2147483647)).cast("int")))
    masked = F.when(F.col("_docloom_m").isNull(), F.col(text_col)).otherwise(F.array_join(kept, mark))
    joined = joined.withColumn(text_col, masked)
    if length_col in docs.columns:
        joined = joined.withColumn(length_col, F.when(F.col("_docloom_m").isNull(), F.col(length_col)).otherwise(
            F.char_length(text_col)).cast(docs.schema[length_col].dataType))
    return joined.select(*docs.columns)
