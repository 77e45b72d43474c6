"""Secret scans: a trigram index picks the candidates of each rule, the rule's regex decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archloom.llm.columns import let
from archloom.llm.trigram_query import ALWAYS, trigram_clauses


@dataclass(frozen=True)
class Rule:
    """One kind of secret.

    pattern: matched leftmost, without overlap. least: characters that group ``group`` needs, else the
    match is dropped. The trigrams that a match must hold are read off the pattern (``trigram_query.py``).
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base kinds come first, as their order breaks ties between spans.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),  # runs are maximal, so the length can stand in the pattern
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def trigram_rows(rules: tuple[Rule, ...]) -> list[tuple[str, str, int, int]]:
    """(trigram, kind, clause, trigrams of the clause) of the rules' queries: an OR of clauses, each an AND of trigrams."""
    out = []
    for rule in rules:
        for i, clause in enumerate(sorted(map(sorted, trigram_clauses(rule.pattern)))):
            out += [(t, rule.kind, i, len(clause)) for t in clause]
    return out


def full_scans(rules: tuple[Rule, ...]) -> list[str]:
    """Rules of which a match need not hold any trigram: they look at every text."""
    return [r.kind for r in rules if trigram_clauses(r.pattern) == ALWAYS]


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans as (start, order, end): the pieces between matches give the places, in code points."""
    pattern = F.lit(rule.pattern)
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["match"]
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["size"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    parts = F.zip_with(F.arrays_zip(matches.alias("match"), sizes.alias("size")), F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(g.alias("gap"), m["match"].alias("match"), m["size"].alias("size")))
    return F.when(text.rlike(rule.pattern), F.aggregate(parts, zero, step, lambda a: a["found"])).otherwise(empty)


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The inverted index (trigram, _id, text_key), of the trigrams that some rule's query asks for."""
    asked = sorted({t for t, *_ in trigram_rows(rules)})
    held = let(F.lower("_text"), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in asked])))
    return docs.select("_id", "text_key", F.explode(held).alias("trigram"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_id, text_key, kinds): the rules of which some clause has all its trigrams in the text."""
    if not trigram_rows(rules):  # all rules scan all texts
        return docs.select("_id", "text_key", F.array().cast("array<string>").alias("kinds")).limit(0)
    values = ", ".join(f"({_quoted(t)}, {_quoted(k)}, {i}, {n})" for t, k, i, n in trigram_rows(rules))
    asked = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS q(trigram, kind, clause, need)")
    hits = postings(docs, rules).distinct().join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
    whole = hits.groupBy("_id", "text_key", "kind", "clause", "need").agg(F.count("*").alias("n")).where("n = need")
    return whole.groupBy("_id", "text_key").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of ``docs``: (id, found array<struct<kind, start, end>>), in order of start, then rule.

    Places are code points, the end exclusive. A null text is an empty one and holds nothing. Rows
    with equal id (null included) and text get equal results. Other columns are ignored.
    """
    read = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("text_key", F.xxhash64("_text"))
    chosen = candidates(read, rules).select(F.col("_id").alias("c_id"), F.col("text_key").alias("c_key"), "kinds").hint("shuffle_hash")
    joined = read.join(chosen, F.col("_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left")
    always = full_scans(rules)
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    found = [
        _spans(F.col("_text"), r, i) if r.kind in always else F.when(F.array_contains("kinds", r.kind), _spans(F.col("_text"), r, i)).otherwise(nothing)
        for i, r in enumerate(rules)
    ]
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.array_sort(F.concat(*found))
    named = F.transform(spans, lambda x: F.struct(F.get(kinds, x["rank"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return joined.select(F.col("_id").alias(id_col), named.alias("found"))


def digest(found: DataFrame, *, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    base = [r.kind for r in rules if r.base]
    show = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(show(F.filter("found", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"),
        show(F.col("found")).alias("spans"),
    )


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {i} AS rank, '{r.kind}' AS kind, {str(r.base).lower()} AS base, {r.least} AS least, regexp_extract_all(text, '{p}', 0) AS m, "
            f"regexp_extract_all(text, '{p}', {r.group}) AS g, string_split_regex(text, '{p}') AS gaps FROM d WHERE regexp_matches(text, '{p}')"
        )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), hit AS (
  {" UNION ALL ".join(parts)}
), each AS (
  SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hit
), placed AS (
  SELECT rid, rank, kind, base, i, least, length(g[i]) AS size,
    length(array_to_string(gaps[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS s, length(m[i]) AS n FROM each
), kept AS (
  SELECT *, kind || ':' || s || ':' || (s + n) AS span FROM placed WHERE size >= least
), by_doc AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
    string_agg(span, ',' ORDER BY s, rank) FILTER (base) AS base_spans, string_agg(span, ',' ORDER BY s, rank) AS spans FROM kept GROUP BY rid
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc USING (rid)
"""


SQL = _sql()
