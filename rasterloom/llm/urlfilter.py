"""URL filters: explicit rules, then a tree of path templates; DataFrame operations only.

Every host has a tree of path segments.  What counts in it are distinct paths:
a page that is there ten times is no more evidence than one.  Level by level,
segments that vary become the wildcard `*` (numbers, also with an extension,
and segments that are rare among many siblings).  The other siblings merge
into one branch (`~` and its kind) if there is evidence on both sides that
they are alike:

- each has `support` paths or more;
- they are of one kind: the shares of paths whose next segment is missing, is
  a number, has an extension, and that have a segment after it, rounded to
  quarters, and what is known of their labels, rounded to halves (the labelled
  share, and the blocked share of it; a sibling without any label is alike only
  to others without);
- each of these shares differs from that of the kind's siblings together by
  `delta` at most, at the upper end of its `z` standard errors.

A branch of its own stays literal (`=segment`).  So no label reaches a sibling
about which nothing is known, and shapes are compared with the pooled branch,
by aggregates: no siblings are put in order, none lie in one group.

Labels are the rules' verdicts: paths that a rule decides teach the templates
that paths without a rule are judged by.  A template's purity is the share of
allowed paths among its labelled ones, smoothed towards the purity of the
template above it (even odds above the first) by `strength` pseudo-paths and
`open_weight` for each of its paths without label.  A template is rejected if
its purity is under `least_purity` and at least `labels` of its own paths, and
`coverage` of them all, are labelled.

Host: from the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; path:
from there to `?`, `#` or the end.  A rule `host/path` fits its host and all
subdomains where the path starts with the rule's; the longest rule wins.

Edge cases: a null url, or one without `://`, has an empty host and path and
is allowed unless its template is rejected; repeated rows are judged alike;
empty tables give no rows.  Other columns are ignored.  Levels go down until no
two paths share a template.  Distinct paths are made before anything is joined;
what a join takes from an aggregate is written first, so that Spark deals both
sides anew and can split a hot host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NUMBER = "^[0-9]+([.][A-Za-z0-9]+)?$"


@dataclass(frozen=True)
class Evidence:
    """What it takes to generalise, merge and reject."""

    siblings: int = 20
    rare: int = 4
    support: int = 8
    z: float = 1.96
    delta: float = 0.25
    strength: float = 4.0
    open_weight: float = 0.1
    least_purity: float = 0.25
    labels: int = 5
    coverage: float = 0.2


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_of(rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, its verdict) for host and path; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda x: (len(x), x)):  # the longest is tested first
        host, slash, path = r.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(rules[r])).otherwise(verdict)
    return rule, verdict


#: what siblings are compared by: (part, whole)
_SHARES = (("ending", "n"), ("numbered", "n"), ("dotted", "n"), ("deeper", "n"), ("labelled", "n"), ("bad", "labelled"))


def _kind() -> Column:
    """Shape and labels of a sibling, rounded: siblings of one kind may merge."""
    quarters = [F.floor((F.col(c) * 8 + F.col("n")) / (F.col("n") * 2)).cast("string") for c in ("ending", "numbered", "dotted", "deeper")]
    known, bad = F.floor((F.col("labelled") * 4 + F.col("n")) / (F.col("n") * 2)), F.floor((F.col("bad") * 4 + F.col("labelled")) / (F.greatest("labelled", F.lit(1)) * 2))
    return F.concat(*quarters, F.when(F.col("labelled") > 0, F.concat(F.lit("."), known.cast("string"), bad.cast("string"))).otherwise(""))


def _alike(part: str, whole: str, e: Evidence) -> Column:
    """Is the share within `delta` of the pooled one, its error included? A share of nothing is."""
    share = (F.col(part) + 1) / (F.col(whole) + 2)
    apart = F.abs(F.col(part) / F.greatest(whole, F.lit(1)) - F.col(f"all_{part}") / F.greatest(f"all_{whole}", F.lit(1)))
    return (F.col(whole) == 0) | (apart + e.z * F.sqrt(share * (1 - share) / (F.col(whole) + 2)) <= e.delta)


def _signs(deep: DataFrame, e: Evidence) -> DataFrame:
    """host, template, seg and its sign: `*`, `~` and a kind, or `=seg`."""
    node, sums = ["host", "template"], ["n", *(p for p, _ in _SHARES)]
    nodes = materialise(deep.groupBy(*node).agg(F.sum("n").alias("node_n"), F.count("*").alias("k")), "url-nodes")
    varies = F.col("seg").rlike(_NUMBER) | ((F.col("k") >= e.siblings) & (F.col("n") * F.col("k") <= e.rare * F.col("node_n")))
    deep = deep.join(nodes, node).withColumn("varies", varies).withColumn("kind", F.when(~F.col("varies") & (F.col("n") >= e.support), _kind()))
    pooled = deep.filter("kind is not null").groupBy(*node, "kind").agg(*(F.sum(c).alias(f"all_{c}") for c in sums), F.count("*").alias("members")).filter("members > 1")
    tested = deep.join(materialise(pooled, "url-kinds"), [*node, "kind"], "left")
    alike = F.col("members").isNotNull()
    for part, whole in _SHARES:
        alike &= _alike(part, whole, e)
    sign = F.when(F.col("varies"), "*").when(alike, F.concat(F.lit("~"), "kind")).otherwise(F.concat(F.lit("="), "seg"))
    return materialise(tested.select(*node, "seg", sign.alias("sign"), (F.col("node_n") == 1).alias("lone")), "url-signs")


def _alone(segment: Column) -> Column:
    return F.concat(F.lit("/"), F.when(segment.rlike(_NUMBER), "*").otherwise(F.concat(F.lit("="), segment)))


def _templates(paths: DataFrame, e: Evidence) -> DataFrame:
    """host, path, labelled, bad and the templates of each level, from the host's own; one row a host and path."""
    columns = ["host", "path", "labelled", "bad", "segments", "above", "template"]
    now = paths.withColumn("segments", F.split(F.regexp_replace("path", "^/", ""), "/")).withColumn("above", F.array(F.lit(""))).withColumn("template", F.lit(""))
    now, done, level = materialise(now.select(*columns), "url-templates"), [], 1
    while True:
        seg, below = (F.try_element_at("segments", F.lit(k)) for k in (level, level + 1))
        counts = {
            "n": F.lit(1), "ending": below.isNull(), "numbered": F.coalesce(below.rlike(_NUMBER), F.lit(False)), "dotted": F.coalesce(below.contains("."), F.lit(False)),
            "deeper": F.size("segments") > level + 1, "labelled": F.col("labelled"), "bad": F.col("bad"),
        }
        deep = now.filter(seg.isNotNull()).groupBy("host", "template", seg.alias("seg")).agg(*(F.sum(c.cast("long")).alias(k) for k, c in counts.items()))
        deep = materialise(deep, "url-segments")
        if deep.isEmpty():
            break
        longer = F.concat("template", F.lit("/"), "sign")
        # a template of one path stays so: the rest of it needs no other
        rest = F.sequence(F.lit(level), F.size("segments"))
        tails = F.transform(rest, lambda i: F.concat("template", F.array_join(F.transform(F.slice("segments", F.lit(level), i - (level - 1)), _alone), "")))
        grown = now.withColumn("seg", seg).join(_signs(deep, e), ["host", "template", "seg"], "left")
        grown = grown.withColumn("above", F.when(F.col("sign").isNull(), F.col("above")).when(F.col("lone"), F.concat("above", tails)).otherwise(F.concat("above", F.array(longer))))
        over = F.col("sign").isNull() | F.col("lone") | (F.size("segments") <= level)
        grown = materialise(grown.select(*(c for c in columns if c != "template"), F.element_at("above", -1).alias("template"), over.alias("over")), "url-templates")
        done.append(grown.filter("over").select(*columns))
        now, level = grown.filter("not over").select(*columns), level + 1
    every = now
    for d in done:
        every = every.unionByName(d)
    return every.select("host", "path", "labelled", "bad", "above", "template")


def _verdicts(known: DataFrame, e: Evidence) -> DataFrame:
    """host, template and learned of every template that a path ends with."""
    each = known.select("host", "labelled", "bad", F.explode("above").alias("level_template"))
    sums = materialise(each.groupBy("host", "level_template").agg(F.count("*").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "url-sums")
    chains = known.select("host", "template", "above").distinct().select("host", "template", F.posexplode("above").alias("level", "level_template"))
    chains = materialise(chains, "url-chains").join(sums, ["host", "level_template"])
    chain = F.sort_array(F.collect_list(F.struct("level", "n", "labelled", "bad")))  # as long as the path is deep
    chains = chains.groupBy("host", "template").agg(chain.alias("chain"))

    def smoothed(above: Column, x: Column) -> Column:
        pseudo = e.strength + e.open_weight * (x["n"] - x["labelled"])
        return (x["labelled"] - x["bad"] + pseudo * above) / (x["labelled"] + pseudo)

    own, purity = F.element_at("chain", -1), F.aggregate("chain", F.lit(0.5), smoothed)
    reject = (purity < e.least_purity) & (own["labelled"] >= e.labels) & (own["labelled"] >= e.coverage * own["n"])
    return chains.select("host", "template", F.when(reject, "block").otherwise("allow").alias("learned"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, evidence: Evidence = Evidence()) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every page."""
    rule, said = rule_of(rules)
    rows = with_parts(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("said", said)
    # a path's label is the same on all its rows
    paths = rows.groupBy("host", "path").agg(F.max(F.col("said").isNotNull().cast("long")).alias("labelled"), F.max(F.coalesce(F.col("said") == "block", F.lit(False)).cast("long")).alias("bad"))
    known = _templates(paths, evidence)
    verdicts = materialise(_verdicts(known, evidence), "url-verdicts")
    decided = materialise(known.select("host", "path", "template").join(verdicts, ["host", "template"]), "url-decided")
    return rows.join(decided, ["host", "path"]).select("page_id", "host", "path", "rule", F.coalesce("said", "learned").alias("verdict"), "template")


def decisions(judged: DataFrame) -> DataFrame:
    """How many pages each rule decides, and how many the templates: by, verdict, pages."""
    return judged.groupBy(F.coalesce("rule", F.lit("template")).alias("by"), "verdict").agg(F.count("*").alias("pages"))


def oracle(rules: dict[str, str] = RULES, e: Evidence = Evidence(), levels: int = 8) -> str:
    """The same as DuckDB SQL, for paths of up to `levels` segments."""
    rule, said = "NULL", "NULL"
    for r in sorted(rules, key=lambda x: (len(x), x)):
        host, slash, path = r.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"
        rule, said = f"CASE WHEN {fits} THEN '{r}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{rules[r]}' ELSE {said} END"
    kind = " || ".join(f"(({c} * 8 + n) // (n * 2))" for c in ("ending", "numbered", "dotted", "deeper"))
    kind += " || CASE WHEN labelled > 0 THEN '.' || ((labelled * 4 + n) // (n * 2)) || ((bad * 4 + labelled) // (labelled * 2)) ELSE '' END"

    def alike(part: str, whole: str) -> str:
        share = f"(({part} + 1)::DOUBLE / ({whole} + 2))"
        pooled = f"sum({part}) OVER g::DOUBLE / sum({whole}) OVER g"
        return f"({whole} = 0 OR abs({part}::DOUBLE / {whole} - {pooled}) + {e.z} * sqrt({share} * (1 - {share}) / ({whole} + 2)) <= {e.delta})"

    steps = []
    for d in range(1, levels + 1):
        steps.append(f"""deep{d} AS (
  SELECT host, template, segments[{d}] AS seg, count(*) AS n,
    count(*) FILTER (len(segments) = {d}) AS ending,
    count(*) FILTER (regexp_matches(segments[{d + 1}], '{_NUMBER}')) AS numbered,
    count(*) FILTER (contains(segments[{d + 1}], '.')) AS dotted,
    count(*) FILTER (len(segments) > {d + 1}) AS deeper,
    sum(labelled)::BIGINT AS labelled, sum(bad)::BIGINT AS bad
  FROM t{d - 1} WHERE len(segments) >= {d} GROUP BY ALL
), varied{d} AS (
  SELECT *, regexp_matches(seg, '{_NUMBER}') OR (count(*) OVER w >= {e.siblings} AND n * count(*) OVER w <= {e.rare} * sum(n) OVER w) AS varies
  FROM deep{d} WINDOW w AS (PARTITION BY host, template)
), kind{d} AS (
  SELECT *, CASE WHEN NOT varies AND n >= {e.support} THEN {kind} END AS kind FROM varied{d}
), sign{d} AS (
  SELECT host, template, seg,
    CASE WHEN varies THEN '*'
      WHEN kind IS NOT NULL AND count(*) OVER g > 1 AND {" AND ".join(alike(*x) for x in _SHARES)} THEN '~' || kind
      ELSE '=' || seg END AS sign
  FROM kind{d} WINDOW g AS (PARTITION BY host, template, kind)
), t{d} AS (
  SELECT t.host, t.path, t.labelled, t.bad, t.segments,
    CASE WHEN sign IS NULL THEN t.above ELSE list_append(t.above, t.template || '/' || sign) END AS above,
    CASE WHEN sign IS NULL THEN t.template ELSE t.template || '/' || sign END AS template
  FROM t{d - 1} t LEFT JOIN sign{d} s ON t.host = s.host AND t.template = s.template AND t.segments[{d}] = s.seg
)""")
    pseudo = f"({e.strength} + {e.open_weight} * (x.n - x.labelled))"
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (SELECT page_id, host, path, {rule} AS rule, {said} AS said FROM p),
t0 AS (
  SELECT host, path, max(CASE WHEN said IS NULL THEN 0 ELSE 1 END) AS labelled, max(CASE WHEN said = 'block' THEN 1 ELSE 0 END) AS bad,
    string_split(regexp_replace(path, '^/', ''), '/') AS segments, [''] AS above, '' AS template
  FROM r GROUP BY host, path
), {", ".join(steps)},
sums AS (
  SELECT host, level_template, count(*) AS n, sum(labelled) AS labelled, sum(bad) AS bad
  FROM (SELECT host, labelled, bad, unnest(above) AS level_template FROM t{levels}) GROUP BY ALL
), chain AS (
  SELECT c.host, c.template, list(struct_pack(level := c.level, n := n, labelled := s.labelled, bad := s.bad) ORDER BY c.level) AS chain
  FROM (SELECT DISTINCT host, template, unnest(above) AS level_template, unnest(range(len(above))) AS level FROM t{levels}) c JOIN sums s USING (host, level_template)
  GROUP BY ALL
), purity AS (
  SELECT host, template, chain[-1] AS own, list_reduce(chain, lambda a, x: (x.labelled - x.bad + {pseudo} * a) / (x.labelled + {pseudo}), 0.5::DOUBLE) AS purity FROM chain
), v AS (
  SELECT host, template,
    CASE WHEN purity < {e.least_purity} AND own.labelled >= {e.labels} AND own.labelled >= {e.coverage} * own.n THEN 'block' ELSE 'allow' END AS learned
  FROM purity
)
SELECT page_id, host, path, rule, coalesce(said, learned) AS verdict, template
FROM r JOIN t{levels} USING (host, path) JOIN v USING (host, template)
"""
