"""Secret scans: credential parts by pattern, weak parts only where complementary ones are near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weaksift.llm.common import stage

REACH = 200  # code points between the starts of parts that belong together


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_IS = r"""["']?\x20*[:=]\x20*["']?"""

# Kinds in the order in which spans with the same start are told: pattern, role, whether it counts on its own.
ASSIGN = f"({_any_case('password|passwd|secret|token|api_?key')}){_IS}([A-Za-z0-9+/_.=-]+)"
KINDS = {
    "assign": (ASSIGN, "secret", True),
    "access": (r"AKIA[A-Z0-9]+", "identifier", True),
    "hex": (r"[0-9a-f]+", "secret", True),
    "opaque": (r"[A-Za-z0-9+/_-]{20,}", "secret", False),
    "login": (f"({_any_case('username|user|login|account|client_?id|access_?key_?id')}){_IS}([A-Za-z0-9@._-]+)", "identifier", False),
    "endpoint": (r"[a-z]+://[A-Za-z0-9._:@/-]+", "endpoint", False),
}
# Java's patterns that find a text worth splitting; they only save work.
HINTS = {"hex": "[0-9a-f]{16}", "access": "AKIA[A-Z0-9]", "endpoint": "://"}
# A match can begin at the first letter of a run only: the one before would have taken the run's start along. Told to
# Java, the search is linear on long runs of letters.
RUNS = {"endpoint": r"(?<![a-z])[a-z]++://[A-Za-z0-9._:@/-]+"}
PLACE = {kind: i for i, kind in enumerate(KINDS)}


def _holds(kind: str, found: Column) -> Column:
    """Whether a match counts."""
    if kind == "assign":
        return F.length(F.regexp_extract(found, ASSIGN, 2)) >= 12
    if kind == "access":
        return F.length(found) >= 18
    if kind == "hex":
        return F.length(found) >= 16
    if kind == "opaque":
        mixed = found.rlike("[a-z]") & found.rlike("[A-Z]") & found.rlike("[0-9]")
        return mixed & (F.size(F.array_distinct(F.split(found, ""))) >= 10)
    if kind == "login":
        return F.length(F.regexp_extract(found, KINDS["login"][0], 2)) >= 3
    return F.lit(True)


def _matches(kind: str) -> Column:
    """The gaps and matches of a text in turn, as lengths."""
    pattern = RUNS.get(kind, KINDS[kind][0])
    pair = F.zip_with(
        F.split("text", pattern, -1),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(0)),
        lambda gap, found: F.struct(
            F.length(gap).alias("gap"),
            F.coalesce(F.length(found), F.lit(0)).alias("long"),
            (found.isNotNull() & F.coalesce(_holds(kind, found), F.lit(False))).alias("holds"),
        ),
    )
    none = F.array().cast("array<struct<gap:int,long:int,holds:boolean>>")
    return F.when(F.col("text").rlike(HINTS.get(kind, pattern)), pair).otherwise(none)


def candidate_spans(texts: DataFrame) -> DataFrame:
    """_row, kind, start, end of each match that holds, from the lengths of gaps and matches ahead of it."""
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("found")) for k, i in PLACE.items()])
    each = texts.select("_row", F.explode(kinds).alias("k")).select("_row", "k.kind", F.posexplode("k.found").alias("i", "m"))
    ahead = W.partitionBy("_row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.long")).over(ahead)
    spans = each.select("_row", "kind", (end - F.col("m.long")).alias("start"), end.alias("end"), F.col("m.holds").alias("holds"))
    return spans.where("holds").drop("holds")


def link_parts(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """The spans to report. Base kinds always are. A weak one is if it overlaps no base span and, within ``reach`` of
    its start, an opaque value has an identifier, a login a secret, and an endpoint both: an interval join of the
    parts of a document, as windows over the range of their starts."""
    roles = {role: [PLACE[k] for k, v in KINDS.items() if v[1] == role] for role in ("secret", "identifier", "endpoint")}
    base = F.col("kind").isin([PLACE[k] for k, v in KINDS.items() if v[2]])
    by_start = W.partitionBy("_row").orderBy("start")
    reached = F.max(F.when(base, F.col("end"))).over(by_start.rangeBetween(W.unboundedPreceding, 0))
    from_end = W.partitionBy("_row").orderBy(F.desc("start"))  # a growing frame, which needs no recount per row
    ahead = F.min(F.when(base, F.col("start"))).over(from_end.rangeBetween(W.unboundedPreceding, 0))
    clear = ~(F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False)))
    parts = spans.withColumn("base", base).withColumn("clear", clear).where("base or clear")
    near = by_start.rangeBetween(-reach, reach)
    has = {role: F.max(F.col("kind").isin(kinds)).over(near) for role, kinds in roles.items()}
    linked = F.when(F.col("base"), True)
    linked = linked.when(F.col("kind").isin(roles["secret"]), F.col("identifier")).when(F.col("kind").isin(roles["identifier"]), F.col("secret"))
    linked = linked.otherwise(F.col("identifier") & F.col("secret"))
    return parts.withColumn("identifier", has["identifier"]).withColumn("secret", has["secret"]).where(linked)


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Every row with the spans found in its whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_linked (weak spans reported).

    Null texts are empty; rows are told apart even if ids repeat or are null; an empty table gives an empty result;
    other columns are ignored. The texts are read once; what later steps shuffle are lengths.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = stage(texts.select("_row", "doc_id", *[_matches(k).alias(k) for k in KINDS]), "matches")
    spans = link_parts(candidate_spans(found), reach)
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.concat_ws(":", F.element_at(names, F.col("kind") + 1), "start", "end")
    is_base = F.col("kind") < 3
    item = F.struct("start", "kind", told.alias("told"))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(items), lambda x: x["told"]), ",")

    by_doc = spans.groupBy("_row").agg(
        *[F.count(F.when(F.col("kind") == PLACE[k], 1)).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.count(F.when(~is_base, 1)).alias("n_linked"),
        joined(F.collect_list(F.when(is_base, item))).alias("base"),
        joined(F.collect_list(item)).alias("spans"),
    )
    counts = ["n_assign", "n_access", "n_hex", "n_linked"]
    return found.select("_row", "doc_id").join(by_doc, "_row", "left").select(
        "doc_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _sql(reach: int = REACH) -> str:
    holds = {
        "assign": f"length(regexp_extract(m, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 12",
        "access": "length(m) >= 18",
        "hex": "length(m) >= 16",
        "opaque": "regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[0-9]')"
        " and len(list_distinct(string_split(m, ''))) >= 10",
        "login": f"length(regexp_extract(m, '{KINDS['login'][0].replace(chr(39), chr(39) * 2)}', 2)) >= 3",
        "endpoint": "true",
    }
    parts = []
    for kind, (pattern, _, _) in KINDS.items():
        p = pattern.replace("'", "''")
        parts.append(
            f"select r, {PLACE[kind]} as kind, i, m, length(g) as gap, coalesce(length(m), 0) as long, m is not null and ({holds[kind]}) as ok"
            f" from (select r, unnest(regexp_split_to_array(t, '{p}')) as g,"
            f" unnest(list_concat(regexp_extract_all(t, '{p}'), [null])) as m,"
            f" unnest(range(len(regexp_split_to_array(t, '{p}')))) as i from texts)"
        )
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
pieces as ({' union all '.join(parts)}),
ends as (select *, sum(gap + long) over (partition by r, kind order by i) as stop from pieces),
spans as (select r, kind, (stop - long)::bigint as start, stop::bigint as stop, kind < 3 as base from ends where ok),
clear as (
  select *, max(case when base then stop end) over (partition by r order by start range between unbounded preceding and current row) as reached,
    min(case when base then start end) over (partition by r order by start range between current row and unbounded following) as ahead
  from spans),
linked as (
  select *, max(kind in (1, 4)) over near as has_identifier, max(kind in (0, 2, 3)) over near as has_secret
  from clear where base or not (coalesce(reached > start, false) or coalesce(ahead < stop, false))
  window near as (partition by r order by start range between {reach} preceding and {reach} following)),
told as (
  select *, {names}[kind + 1] || ':' || start || ':' || stop as span from linked
  where base or case kind when 3 then has_identifier when 4 then has_secret else has_identifier and has_secret end),
by_doc as (
  select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    count(*) filter (not base) as n_linked, string_agg(span, ',' order by start, kind) filter (base) as base,
    string_agg(span, ',' order by start, kind) as spans from told group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  coalesce(n_linked, 0) as n_linked, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join by_doc using (r)
"""


ORACLE = _sql()
