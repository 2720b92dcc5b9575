"""URL filter by a path-template tree, on DataFrame functions only.

Urls that a rule judges are the labelled ones. Per host, path segments that are variable by their form
(numbers, dates, hashes) or by their count below one parent become wildcards; sibling templates whose
labels are statistically alike (Wilson interval of the blocked share above, below or across one half)
are merged. Labels are pooled up the tree: a host's purity is (blocked + 1) / (labelled + 2), that of a
first segment is smoothed by its host's, (blocked + 2 host) / (labelled + 2), and a template's by its first
segment's in the same way. So a template with labels of its own is judged by them, and one with none by its
host. It is rejected when its purity reaches PURITY. A rule's own verdict always goes first.

The tree has the first DEPTH segments of a path: deeper paths that agree in them share a template, with a flag
that they go on.

Scale: only url is read from the pages. Everything after the first aggregation works on one row per
host and generalised path; a host with a third of all pages is counted map-side and joined back by
`join_groups`. Rules are literals in the plan and refused above MAX_RULES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_groups, read

#: (rule, verdict); the part before the first slash is the host.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MAX_RULES = 1000
DEPTH = 4
BRANCHES = 20
PURITY = 0.9
#: Labels that the purity of the level above counts as.
PRIOR = 2.0
Z = 1.96
ABSENT = "/"  # no segment can be this

#: Form of a segment -> its wildcard, in order.
FORMS = (
    (r"^[0-9]+$", "{n}"),
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"),
    (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "{uuid}"),
    (r"^[0-9a-f]{8,}$", "{hex}"),
    (r"^.{41,}$", "{long}"),
)
NUMBERED = r"^[0-9]+(\.[A-Za-z0-9]{1,5})$"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_S = [f"s{k}" for k in range(1, DEPTH + 1)]
_T = [f"t{k}" for k in range(1, DEPTH + 1)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and where there is no ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def first_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null without one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _form(segment: Column) -> Column:
    out = F.when(segment.rlike(NUMBERED), F.concat(F.lit("{n}"), F.regexp_extract(segment, NUMBERED, 1))).otherwise(segment)
    for pattern, name in reversed(FORMS):
        out = F.when(segment.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _class(blocked: Column, labelled: Column) -> Column:
    """bad, good or open: where the Wilson interval of the blocked share lies against one half."""
    z2 = Z * Z
    middle = (blocked + z2 / 2) / (labelled + z2)
    half = F.lit(Z) * F.sqrt(blocked * (labelled - blocked) / F.greatest(labelled, F.lit(1)) + z2 / 4) / (labelled + z2)
    return F.when(middle - half > 0.5, "bad").when(middle + half < 0.5, "good").otherwise("open")


def url_filter(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, template, n_labelled, purity.

    Null urls and those without :// have an empty host and path and form a host of their own. Repeated
    rows and ids each give a row; other columns are not looked at; an empty table gives an empty result.
    """
    space = Workspace(pages.sparkSession, "url_filter")
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("found", first_rule(F.col("host"), F.col("path"), rules))
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    rows = rows.withColumn("parts", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(parts))
    rows = rows.select("id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"), *[F.coalesce(_form(F.try_element_at("parts", F.lit(k + 1))), F.lit(ABSENT)).alias(s) for k, s in enumerate(_S)], (F.size("parts") > DEPTH).alias("deeper"))
    rows = space.table(rows)
    total = rows.count()
    tree = space.table(rows.groupBy("host", *_S, "deeper").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked")))
    for k in range(DEPTH):
        above, here = ["host", *_T[:k]], _S[k]
        kinds = tree.groupBy(*above, here).agg(F.count("*").alias("n_rows")).groupBy(*above).agg(F.count_if(F.col(here) != ABSENT).alias("kinds"), F.sum("n_rows").alias("n_rows"))
        wild = (F.col(here) != ABSENT) & (F.col("kinds") >= BRANCHES)
        tree = space.table(join_groups(tree, kinds, above, "n_rows", total).withColumn(_T[k], F.when(wild, "*").otherwise(F.col(here))).drop("kinds", "n_rows"))
    # Templates with their labels; each keeps its class while siblings of one class merge, depth by depth.
    merged = tree.groupBy("host", *_T, "deeper").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.count("*").alias("n_rows"))
    merged = merged.withColumn("class", _class(F.col("blocked"), F.col("labelled")))
    m = [f"m{k}" for k in range(1, DEPTH + 1)]
    merged = space.table(merged.withColumns(dict(zip(m, map(F.col, _T)))))
    for k in range(DEPTH):
        others = ["host", *[x for x in m if x != m[k]], "deeper", "class"]
        like = merged.groupBy(*others).agg(F.min(m[k]).alias("low"), F.max(m[k]).alias("high"), F.count_if(F.col(m[k]) == ABSENT).alias("none"), F.count("*").alias("n_alike"))
        joins = (F.col("low") != F.col("high")) & (F.col("none") == 0)
        merged = space.table(join_groups(merged, like, others, "n_alike", total).withColumn(m[k], F.when(joins, "*").otherwise(F.col(m[k]))).drop("low", "high", "none", "n_alike"))
    final = ["host", *m, "deeper", "class"]
    judged = merged.groupBy(*final).agg(F.sum("blocked").alias("all_blocked"), F.sum("labelled").alias("n_labelled"), F.count("*").alias("n_alike"))
    # labels of the host and of the first segment, one row each
    pooled = [F.sum("blocked"), F.sum("labelled"), F.count("*")]
    hosts = merged.groupBy("host").agg(*[c.alias(n) for c, n in zip(pooled, ("host_blocked", "host_labelled", "n_host"))])
    firsts = merged.groupBy("host", m[0]).agg(*[c.alias(n) for c, n in zip(pooled, ("first_blocked", "first_labelled", "n_first"))])
    judged = join_groups(join_groups(judged, hosts, ["host"], "n_host", total), firsts, ["host", m[0]], "n_first", total)
    of_host = (F.col("host_blocked") + 1.0) / (F.col("host_labelled") + 2.0)
    of_first = (F.col("first_blocked") + F.lit(PRIOR) * of_host) / (F.col("first_labelled") + PRIOR)
    judged = judged.withColumn("purity", (F.col("all_blocked") + F.lit(PRIOR) * of_first) / (F.col("n_labelled") + PRIOR)).select(*final, "n_labelled", "purity", "n_alike")
    named = join_groups(merged.select("host", *_T, "deeper", "class", *m, "n_rows"), judged, final, "n_alike", total)
    shown = [F.when(F.col(x) == ABSENT, "").otherwise(F.concat(F.lit("/"), F.col(x))) for x in m]
    named = named.select("host", *_T, "deeper", F.concat(*shown, F.when(F.col("deeper"), "/**").otherwise("")).alias("template"), "n_labelled", "purity", (F.col("purity") >= PURITY).alias("impure"), F.col("n_rows").alias("n_tree"))
    leaves = space.table(join_groups(tree.drop("labelled", "blocked"), named, ["host", *_T, "deeper"], "n_tree", total).select("host", *_S, "deeper", "n", "template", "n_labelled", "purity", "impure"))
    out = join_groups(rows, leaves, ["host", *_S, "deeper"], "n", total)
    verdict = F.coalesce("ruled", F.when(F.col("impure"), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "n_labelled", "purity")


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def oracle() -> str:
    """The same in DuckDB SQL, written out from the same constants."""
    t, s, m = ", ".join(_T), ", ".join(_S), [f"m{k}" for k in range(1, DEPTH + 1)]
    ctes = [
        r"u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        r"h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u)",
        rf"p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)",
    ]
    cases = []
    for rule, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        cases.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')", rule, verdict))
    ctes.append("r AS (SELECT *, CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases) + " END AS rule, CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases) + " END AS ruled, CASE WHEN path = '' THEN [] ELSE string_split(regexp_replace(path, '^/', ''), '/') END AS parts FROM p)")

    def form(x: str) -> str:
        return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for p, n in FORMS) + f" WHEN regexp_matches({x}, '{NUMBERED}') THEN '{{n}}' || regexp_extract({x}, '{NUMBERED}', 1) ELSE {x} END"

    ctes.append("b AS (SELECT page_id, host, path, rule, ruled, " + ", ".join(f"coalesce({form(f'parts[{k + 1}]')}, '{ABSENT}') AS {c}" for k, c in enumerate(_S)) + f", len(parts) > {DEPTH} AS deeper FROM r)")
    ctes.append(f"g0 AS (SELECT host, {s}, deeper, count(ruled) AS labelled, count(*) FILTER (WHERE ruled = 'block') AS blocked FROM b GROUP BY ALL)")
    for k in range(DEPTH):
        above, here = ", ".join(["host", *_T[:k]]), _S[k]
        ctes.append(f"g{k + 1} AS (SELECT g{k}.*, CASE WHEN {here} <> '{ABSENT}' AND kinds >= {BRANCHES} THEN '*' ELSE {here} END AS {_T[k]} FROM g{k} JOIN (SELECT {above}, count(DISTINCT {here}) FILTER (WHERE {here} <> '{ABSENT}') AS kinds FROM g{k} GROUP BY {above}) USING ({above}))")
    z2 = Z * Z
    mid, half = f"(blocked + {z2 / 2!r}) / (labelled + {z2!r}::DOUBLE)", f"{Z} * sqrt(blocked * (labelled - blocked) / greatest(labelled, 1)::DOUBLE + {z2 / 4!r}) / (labelled + {z2!r}::DOUBLE)"
    ctes.append(f"a AS (SELECT host, {t}, deeper, sum(blocked) AS blocked, sum(labelled) AS labelled FROM g{DEPTH} GROUP BY ALL)")
    ctes.append(f"c0 AS (SELECT *, CASE WHEN {mid} - {half} > 0.5 THEN 'bad' WHEN {mid} + {half} < 0.5 THEN 'good' ELSE 'open' END AS class, " + ", ".join(f"{x} AS {y}" for x, y in zip(_T, m)) + " FROM a)")
    for k in range(DEPTH):
        others = ", ".join(["host", *[x for x in m if x != m[k]], "deeper", "class"])
        ctes.append(f"c{k + 1} AS (SELECT * REPLACE (CASE WHEN min({m[k]}) OVER w <> max({m[k]}) OVER w AND count(*) FILTER (WHERE {m[k]} = '{ABSENT}') OVER w = 0 THEN '*' ELSE {m[k]} END AS {m[k]}) FROM c{k} WINDOW w AS (PARTITION BY {others}))")
    final = ", ".join(["host", *m, "deeper", "class"])
    shown = " || ".join(f"CASE WHEN {x} = '{ABSENT}' THEN '' ELSE '/' || {x} END" for x in m)
    ctes.append(f"j AS (SELECT host, {t}, deeper, {shown} || CASE WHEN deeper THEN '/**' ELSE '' END AS template, (sum(labelled) OVER w)::BIGINT AS n_labelled, (sum(blocked) OVER w)::DOUBLE AS all_blocked, (sum(blocked) OVER h)::DOUBLE AS hb, (sum(labelled) OVER h)::DOUBLE AS hl, (sum(blocked) OVER f)::DOUBLE AS fb, (sum(labelled) OVER f)::DOUBLE AS fl FROM c{DEPTH} WINDOW w AS (PARTITION BY {final}), h AS (PARTITION BY host), f AS (PARTITION BY host, m1))")
    one, two, prior = "1.0::DOUBLE", "2.0::DOUBLE", f"{PRIOR}::DOUBLE"
    ctes.append(f"q AS (SELECT * EXCLUDE (all_blocked, hb, hl, fb, fl), (all_blocked + {prior} * ((fb + {prior} * ((hb + {one}) / (hl + {two}))) / (fl + {prior}))) / (n_labelled::DOUBLE + {prior}) AS purity FROM j)")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {PURITY}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, template, n_labelled, purity
FROM b JOIN g{DEPTH} USING (host, {s}, deeper) JOIN q USING (host, {t}, deeper)"""


ORACLE = oracle()
