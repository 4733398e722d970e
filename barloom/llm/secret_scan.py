"""Secrets in texts, weighed by who holds them in the corpus. DataFrame functions only.

Base kinds are found by fixed patterns. Positions come from the lengths of the stretches between
matches. The method then hashes every candidate value and counts, over the whole corpus, the distinct
repositories and owners that hold it: a value that several owners hold is an example that was copied,
one that a single owner holds looks live. Candidates of the kind ``mixed`` (long runs of upper and
lower case letters and digits) become spans only where one owner holds them; base spans always stay.

A value that a third of all documents hold is counted from distinct (value, owner, repository) rows
that combine on the map side.

Defined cases: a null text counts as empty; null owners or repositories count as one of their own;
rows that repeat id and text give the same row again. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of
from barloom.session import durable

#: Patterns of the base kinds, in the order that breaks ties.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: What the method adds.
MIXED = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "mixed")
_STEP = 256


def prefix_sums(numbers: str) -> Column:
    """Sum of what stands before each element of an array column, in stretches, so that the work
    stays far below the square of the length. Give a stored column, not an expression."""
    x = F.col(numbers)
    zero = F.lit(0).cast("bigint")

    def total(a: Column) -> Column:
        return F.aggregate(a, zero, lambda s, v: s + v)

    n = F.size(x)
    sums = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / _STEP).cast("int")),
        lambda b: total(F.slice(x, b * _STEP + 1, F.lit(_STEP))),
    )
    # Sums of whole stretches before each stretch, then of the rest before each element.
    heads = F.transform(sums, lambda v, i: total(F.slice(sums, F.lit(1), i)))
    return F.when(
        n > 0,
        F.flatten(
            F.transform(
                heads,
                lambda h, b: F.transform(
                    F.slice(x, b * _STEP + 1, F.lit(_STEP)),
                    lambda v, i: h + total(F.slice(x, b * _STEP + 1, i)),
                ),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _matches(text: str, pattern: str, group: int = 0) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.col(text).rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)


def _gaps(text: str, pattern: str) -> Column:
    none = F.array().cast("array<int>")
    return F.when(
        F.col(text).rlike(pattern), F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    ).otherwise(none)


def _widths(matches: str, gaps: str) -> Column:
    """Characters from the end of the match before to the end of each match."""
    return F.transform(
        F.col(matches), lambda m, i: (F.element_at(F.col(gaps), i + 1) + F.length(m)).cast("bigint")
    )


def _spans(kind: str, number: int, values: Column) -> Column:
    def span(m, i):
        start = F.element_at(F.col(f"_b_{kind}"), i + 1) + F.element_at(F.col(f"_g_{kind}"), i + 1)
        return F.struct(
            start.alias("start"),
            F.lit(number).alias("kind"),
            (start + F.length(m)).alias("end"),
            F.element_at(values, i + 1).alias("value"),
        )

    return F.transform(F.col(f"_m_{kind}"), span)


def spans_of(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_spans``: array of ``start, kind, end, value`` of all kinds; every other column but
    the text stays."""
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, MIXED)))
    df = docs.withColumn("_t", text_of(text))
    for kind, p in patterns.items():
        df = df.withColumn(f"_m_{kind}", _matches("_t", p)).withColumn(f"_g_{kind}", _gaps("_t", p))
    df = df.withColumn("_v_assign", _matches("_t", ASSIGN, 2))
    keep = [c for c in docs.columns if c != text]
    df = df.withColumn("_h", F.xxhash64("_t"))
    for kind in KINDS:
        df = df.withColumn(f"_w_{kind}", _widths(f"_m_{kind}", f"_g_{kind}"))
    df = df.select(
        *[F.col(f"`{c}`") for c in keep],
        "_h",
        *[f"_{x}_{k}" for k in KINDS for x in ("m", "w", "g")],
        "_v_assign",
        *[prefix_sums(f"_w_{k}").alias(f"_b_{k}") for k in KINDS],
    )
    found = []
    for at, kind in enumerate(KINDS):
        value = F.col("_v_assign") if kind == "assign" else F.col(f"_m_{kind}")

        spans = _spans(kind, at, value)
        if kind == "assign":
            spans = F.filter(spans, lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
        if kind == "mixed":
            spans = F.filter(
                spans,
                lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]"),
            )
        found.append(spans)
    return df.select(
        *[F.col(f"`{c}`") for c in keep], "_h", F.array_sort(F.concat(*found)).alias("_spans")
    )


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each value."""
    per_owner = found.select("value", "owner", "repo").distinct().groupBy("value", "owner").agg(
        F.count("*").alias("_r")
    )
    return per_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("_r").alias("repos"))


def label(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def scan(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    *,
    owner: Column | None = None,
    repo: Column | None = None,
    live_owners: int = 1,
) -> DataFrame:
    """Per row: ``key``, ``base`` and ``spans`` (arrays of start, kind number, end, value; ``spans``
    holds the added ones too), ``n_live`` and ``n_copied`` (spans of values that at most, or more
    than, ``live_owners`` owners hold)."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    rows = docs.select(F.col(key).alias("_d"), F.col(text).alias("_x"), owner.alias("_o"), repo.alias("_r"))
    base = durable(spans_of(rows, "_x"))
    found = base.where(F.size("_spans") > 0).select(
        "_d", "_h", F.col("_o").alias("owner"), F.col("_r").alias("repo"), F.explode("_spans").alias("s")
    )
    found = found.withColumn("value", F.sha2("s.value", 256))
    held = ownership(found)
    per_doc = (
        found.select("_d", "_h", "s", "value").distinct()
        .join(held, "value")
        .groupBy("_d", "_h")
        .agg(
            F.array_sort(
                F.collect_list(F.when((F.col("s.kind") < 3) | (F.col("owners") <= live_owners), F.col("s")))
            ).alias("spans"),
            F.count(F.when((F.col("owners") <= live_owners), 1)).alias("n_live"),
            F.count(F.when((F.col("owners") > live_owners), 1)).alias("n_copied"),
        )
        .withColumnsRenamed({"_d": "_pd", "_h": "_ph"})
    )
    out = base.join(per_doc, base["_d"].eqNullSafe(per_doc["_pd"]) & (base["_h"] == per_doc["_ph"]), "left")
    return out.select(
        F.col("_d").alias(key),
        F.filter("_spans", lambda s: s["kind"] < 3).alias("base"),
        F.coalesce("spans", F.filter("_spans", lambda s: F.lit(False))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def scan_sql(table: str = "documents", live_owners: int = 1) -> str:
    """The registered result in plain SQL. Ids must be unique."""
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, MIXED)))

    def kind(n: int, name: str) -> str:
        p = patterns[name].replace("'", "''")
        value = f"regexp_extract_all(t, '{p}', 2)" if name == "assign" else f"regexp_extract_all(t, '{p}')"
        ok = {
            "assign": f"length(v) >= {ASSIGN_LEAST}",
            "mixed": "regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')",
        }.get(name, "true")
        return f"""SELECT doc_id, o, {n} AS k, a, a + length(m) AS b, v FROM (
  SELECT doc_id, o, ms[j] AS m, vs[j] AS v, list_sum([length(g) FOR g IN gs[1:j]])
    + coalesce(list_sum([length(x) FOR x IN ms[1:j - 1]]), 0) AS a
  FROM (SELECT doc_id, o, ms, vs, gs, unnest(range(1, len(ms) + 1)) AS j FROM (
    SELECT doc_id, o, regexp_extract_all(t, '{p}') AS ms, {value} AS vs, string_split_regex(t, '{p}') AS gs FROM d)))
WHERE {ok}"""

    parts = " UNION ALL ".join(kind(n, name) for n, name in enumerate(KINDS))
    named = "CASE k " + " ".join(f"WHEN {n} THEN '{name}'" for n, name in enumerate(KINDS)) + " END"
    text = f"{named} || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS o FROM {table}),
s AS ({parts}),
h AS (SELECT v, count(DISTINCT o) AS owners FROM s GROUP BY 1),
x AS (SELECT s.*, owners, {text} AS told FROM s JOIN h USING (v)),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
  count(*) FILTER (k = 2) AS n_hex, string_agg(told, ',' ORDER BY a, k) FILTER (k < 3) AS base,
  string_agg(told, ',' ORDER BY a, k) FILTER (k < 3 OR owners <= {live_owners}) AS spans,
  count(*) FILTER (owners <= {live_owners}) AS n_live, count(*) FILTER (owners > {live_owners}) AS n_copied FROM x GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g USING (doc_id)"""
