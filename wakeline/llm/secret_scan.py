"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams. The index holds the postings (trigram, document) of
the trigrams that some query names; postings are intersected per document, which gives the candidates of each rule;
candidates are verified with the expression itself. A rule without mandatory trigrams (plain hexadecimal runs) scans
every text.

The candidate list is broadcast up to a checked number of rows and joined by a shuffle beyond it; texts are only
shuffled in that second case.

Defined results: null and empty texts have no spans; a null id cannot be a posting, so its row scans with all rules;
of repeated ids each row is verified on its own text; long texts are scanned whole; further columns pass through,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, trigrams


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # one dialect for Java and Python
    group: int = 0  # the group whose length counts
    least: int = 0  # fewer characters: the match is dropped
    base: bool = False


#: In the order of their kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),  # the same spans as [0-9a-f]+ of 16 characters and more
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BROADCAST_ROWS = 1_000_000
_BITS = 60
#: Matches whose places are summed at once.
_BLOCK = 128
_NO_SPANS = "array<struct<start:int,k:int,end:int>>"


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the rules' queries ask for."""
    return sorted({t for r in rules for clause in trigrams.asked(r.pattern) for t in clause})


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index: (trigram number, id), one row for each document that holds the trigram."""
    low = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary(rules))]))
    return low.select("id", F.explode(held).alias("trigram"))


def store_postings(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index written by trigram below ``path`` and read again: a scan of few rules reads the postings of their
    trigrams alone, and the texts are not read twice for another set of rules with the same vocabulary."""
    postings(docs, id_col, text_col, rules).write.mode("overwrite").partitionBy("trigram").parquet(path)
    return docs.sparkSession.read.parquet(path)


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, mask): the documents in which the intersected postings satisfy a rule; bit k stands for rule k."""
    words = vocabulary(rules)
    at = {t: i for i, t in enumerate(words)}
    n = -(-len(words) // _BITS)
    bit = F.expr(f"shiftleft(1L, trigram % {_BITS})")
    part = (F.col("trigram") / _BITS).cast("int")
    bits = index.groupBy("id").agg(*[F.bit_or(F.when(part == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{j}") for j in range(n)])
    mask = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        q = trigrams.asked(r.pattern)
        if q != trigrams.ALL:
            mask = mask + F.when(_any([_all(clause, at, n) for clause in q]), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits.select("id", mask.alias("mask")).where("mask <> 0")


def _all(clause, at: dict[str, int], n: int) -> Column:
    out = F.lit(True)
    for j in range(n):
        need = sum(1 << (at[t] % _BITS) for t in clause if at[t] // _BITS == j)
        if need:
            out = out & (F.col(f"m{j}").bitwiseAND(F.lit(need).cast("long")) == F.lit(need).cast("long"))
    return out


def _any(xs: list[Column]) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | x
    return out


def _spans(text: str, rule: Rule, k: int) -> Column:
    """array<struct<start, k, end>> of a rule's matches that are long enough, in code points.

    split() gives what lies between the matches and regexp_extract_all() the matches; their lengths add up to places. The
    sums run in blocks of matches, first over the blocks and then inside each, so that a text of very many matches does
    not copy a growing list at each of them.
    """
    t, p = F.col(text), F.lit(rule.pattern)
    none = F.array().cast(_NO_SPANS)
    gaps, found, counted = F.split(t, rule.pattern, -1), F.regexp_extract_all(t, p, F.lit(0)), F.regexp_extract_all(t, p, F.lit(rule.group))
    each = F.arrays_zip(F.transform(gaps, F.char_length).alias("g"), F.transform(found, F.char_length).alias("f"), F.transform(counted, F.char_length).alias("c"))

    def length(x):
        return x["g"] + F.coalesce(x["f"], F.lit(0))

    def step(acc, x):
        end = acc["at"] + length(x)
        keep = x["f"].isNotNull() & (x["c"] >= rule.least)
        one = F.struct((acc["at"] + x["g"]).alias("start"), F.lit(k).alias("k"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def blocks_of(all_):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _BLOCK).cast("int")), lambda b: F.slice(all_, b * _BLOCK + 1, F.lit(_BLOCK)))

    def placed(blocks):
        """Blocks with the place where each begins."""
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + length(x)))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda b, at: F.struct(b.alias("b"), at.alias("at")))

    def inside(z):
        seed = F.struct(z["at"].alias("at"), none.alias("out"))
        return F.aggregate(z["b"], seed, step, lambda a: a["out"])

    # one-element arrays bind what is used twice
    bound = F.flatten(F.transform(F.array(each), lambda all_: F.flatten(F.transform(F.flatten(F.transform(F.array(blocks_of(all_)), placed)), inside))))
    return F.when(F.regexp_like(t, p), bound).otherwise(none)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secret_spans", index: DataFrame | None = None) -> DataFrame:
    """docs with one more column: all spans (start, rule number, end), by start and then rule. A name that is taken gets
    underscores at its end. index: postings of the same documents that were stored before (``store_postings``)."""
    taken = {c.lower() for c in docs.columns}
    while out.lower() in taken:
        out += "_"
    whole, _ = _with_spans(docs, id_col, text_col, rules, index)
    return whole.toDF(*docs.columns, out)


def _with_spans(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...], index: DataFrame | None = None) -> tuple[DataFrame, str]:
    """docs with columns c0, c1, ... in their order and ``spans``; and the name of the text."""
    held = [f"c{i}" for i in range(len(docs.columns))]
    found = common.materialize(candidates(postings(docs, id_col, text_col, rules) if index is None else index, rules), "candidates")
    n = found.count()
    id_, text = (held[docs.columns.index(c)] for c in (id_col, text_col))
    docs = docs.toDF(*held)
    right = F.broadcast(found) if n <= BROADCAST_ROWS else found.hint("shuffle_merge")
    named = docs.join(right, F.col(id_) == F.col("id"), "left").withColumn("scanned", F.coalesce(F.col(text), F.lit("")))
    spans = []
    for k, r in enumerate(rules):
        s = _spans("scanned", r, k)
        if trigrams.query(r.pattern) != trigrams.ALL:
            hit = F.col(id_).isNull() | (F.coalesce("mask", F.lit(0)).bitwiseAND(F.lit(1 << k).cast("long")) != 0)
            s = F.when(hit, s).otherwise(F.array().cast(_NO_SPANS))
        spans.append(s)
    return named.select(*held, F.array_sort(F.concat(*spans)).alias("spans")), text


def written(spans: str, rules: tuple[Rule, ...] = RULES, base: bool = False) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    s = F.col(spans)
    if base:
        s = F.filter(s, lambda x: x["k"].isin([k for k, r in enumerate(rules) if r.base]))
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_col: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret (overlapping ones as one) replaced by <kind>; n_chars follows, where there is such a column."""
    all_, text = _with_spans(docs, id_col, text_col, rules)
    t, kinds = F.col(text), F.array(*[F.lit(f"<{r.kind}>") for r in rules])

    def step(acc, x):
        new = x["start"] >= acc["at"]
        piece = F.concat(F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), F.element_at(kinds, x["k"] + 1))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(new, F.array_append(acc["s"], piece)).otherwise(acc["s"]).alias("s"))

    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("s"))
    clean = F.aggregate("spans", seed, step, lambda a: F.concat(F.array_join(a["s"], ""), F.substring(t, a["at"] + 1, F.char_length(t))))
    hit = F.size("spans") > 0
    all_ = all_.withColumn("clean", F.when(hit, clean).otherwise(t)).withColumn("hit", hit)
    now = {text_col: F.col("clean")}
    if n_col in docs.columns:
        now[n_col] = F.when(F.col("hit"), F.char_length("clean").cast(docs.schema[n_col].dataType)).otherwise(F.col(f"c{docs.columns.index(n_col)}"))
    return all_.select(*[now.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def _count(spans: str, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    count = [_count("secret_spans", k).alias(f"n_{r.kind}") for k, r in enumerate(RULES) if r.base]
    return found.select("doc_id", *count, F.sha2(written("secret_spans", base=True), 256).alias("base_sha256"), written("secret_spans").alias("spans"))


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The result of op9 in DuckDB: every text scanned with every rule."""
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS k, '{r.kind}' AS kind, unnest(list_transform(range(1, len(f) + 1), lambda i: {{'a': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0), 'n': length(f[i]), 'c': length(v[i])}})) AS m
 FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS f, regexp_extract_all(t, '{p}', {r.group}) AS v FROM texts) WHERE len(f) > 0"""
        for k, r in enumerate(rules)
        for p in [r.pattern.replace("'", "''")]
    )
    base = [(k, r.kind) for k, r in enumerate(rules) if r.base]
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules))
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
spans AS (SELECT doc_id, k, kind, m.a AS a, m.a + m.n AS b FROM found WHERE m.c >= CASE k {least} END),
agg AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{n}" for k, n in base)}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k <= {base[-1][0]}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for _, n in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN agg USING (doc_id)"""


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLE = {"op9_secret_scan": _sql()}
