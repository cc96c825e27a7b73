"""Fields of documents, headers, plug-ins and sampled totals: STR-01, STR-10, STR-12, STR-13, UDF-01..03, PRJ-24, WIN-32."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.functions import text
from loamwork.operators import detectors, documents
from loamwork.operators.joins import as_of
from loamwork.plans.base import table
from loamwork.plans.registry import query
from loamwork.plans.series_queries import _GDD, _gdd

# pages of six kinds, one for each customer: lines of segments between bars ------------------------------------------------------

_KINDS = [
    ["To", "{S}|Ravi|KUMAR", "S/O|RAMAPPA|{k}"],
    ["GOVERNMENT|OF|INDIA", "Name:|{S}|k2x|RAO,", "Address|12|Main|Road", "{S}|Nagar"],
    ["Name", "APPLICANT|NAME|{C}", "Father", "{S}"],
    ["Surname", "Name", "{S}|Devi", "5/O:|{S}"],
    ["नाम|{S}|रवि", "D/0|{k}", "5o: {S} Tadalaai|x", "HM|{C}|SHARMA"],
    ["name|of|issue", "Given|Name", "x1|2y", "c/o|{C}", "काम {S}|Rao|Kumar,"],
]
_PAGES = """pages AS (SELECT c_custkey AS page, CASE c_custkey % 6 """ + " ".join(
    f"WHEN {n} THEN [" + ", ".join("replace(replace(replace('" + line + "', '{S}', upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))), '{C}', c_mktsegment), '{k}', c_custkey::VARCHAR)" for line in kind) + "]" for n, kind in enumerate(_KINDS)
) + """ END AS ls FROM customer),
lines AS (SELECT page, generate_subscripts(ls, 1)::INTEGER - 1 AS line, unnest(ls) AS l FROM pages),
w AS (SELECT page, line, generate_subscripts(string_split(l, '|'), 1)::INTEGER - 1 AS pos, unnest(string_split(l, '|')) AS word FROM lines)"""


def _lines(spark, sf_dir):
    segment = F.col("c_mktsegment")

    def made(line):
        out = F.lit(line)
        for mark, value in (("{S}", F.initcap(F.lower(segment))), ("{C}", segment), ("{k}", F.col("c_custkey").cast("string"))):
            out = F.replace(out, F.lit(mark), value)
        return out

    kinds = [F.array(*map(made, kind)) for kind in _KINDS]
    which = F.col("c_custkey") % 6
    chosen = kinds[-1]
    for n, lines in enumerate(kinds[:-1]):
        chosen = F.when(which == n, lines).otherwise(chosen)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.posexplode(chosen).alias("line", "l"))


def _words(spark, sf_dir):
    return _lines(spark, sf_dir).select("page", "line", F.posexplode(F.split("l", "[|]")).alias("pos", "text"))


_LABELS = "name नाम surname उपनाम given दिया", "father fathers s/o d/o w/o c/o पिता husband mother guardian"
_FORM = "^([A-Z][A-Z\\-''’]+|[A-Z][a-z][a-z\\-''’]*|[A-Z]|[ऀ-ॿ]+)$"
_PHRASE = "(?i)^(name[\\(s\\)]*|names|given|surname|उपनाम|दिया|नाम|का|की|के|है|गया|type|code|nationality|sex|date|place|expiry|issue|birth|of|/|namets\\)?)$"


def _sql_label(form: str, more: str = "") -> str:
    name, parent = ("', '".join(words.split()) for words in (_LABELS[0], f"{_LABELS[1]} {more}"))
    return f"CASE WHEN {form} IN ('{name}') THEN 'NAME' WHEN {form} IN ('{parent}') THEN 'PARENT' END"


_BARE = "regexp_replace(x, '[,.;:!?]+$', '')"
_VALUES = f"""WITH {_PAGES},
f AS (SELECT *, regexp_replace(lower(word), '[^a-zA-Z0-9ऀ-ॿ/]', '', 'g') AS t, regexp_replace(lower(split_part(word, ':', 1)), '[^a-zA-Z0-9ऀ-ॿ/]', '', 'g') AS pre, trim(substr(word, instr(word, ':') + 1)) AS suf FROM w),
g AS (SELECT *, coalesce({_sql_label('t')}, {_sql_label("translate(t, '5018', 'soib')")}) AS direct,
  CASE WHEN instr(word, ':') > 0 AND pre <> '' AND suf <> '' AND NOT regexp_matches(split_part(word, ':', 1), '[ऀ-ॿ]') THEN
    coalesce({_sql_label('pre', 'so do wo co')}, {_sql_label("replace(pre, '/', '')", 'so do wo co')}, {_sql_label("translate(pre, '5018', 'soib')", 'so do wo co')}, {_sql_label("translate(replace(pre, '/', ''), '5018', 'soib')", 'so do wo co')}) END AS before,
  array_to_string(list_filter(list_transform(string_split_regex(suf, '\\s+'), lambda x: {_BARE}), lambda x: regexp_matches(x, '{_FORM}')), ' ') AS inner_value,
  (SELECT {_BARE} FROM (SELECT trim(word) AS x)) AS b FROM f),
h AS (SELECT *, coalesce(direct, before) AS label, CASE WHEN direct IS NULL AND before IS NOT NULL AND inner_value <> '' THEN inner_value END AS inside, regexp_matches(b, '{_FORM}') AS shaped, regexp_matches(trim(word), '{_PHRASE}') AS phrase FROM g),
i AS (SELECT page, line, min(pos) FILTER (WHERE label IS NOT NULL) AS at, count(*) AS n, max(label) FILTER (WHERE pos = 0) IS NOT NULL AS begins, max(t) FILTER (WHERE pos = 0) AS t0, coalesce(string_agg(b, ' ' ORDER BY pos) FILTER (WHERE shaped), '') AS everything FROM h GROUP BY 1, 2),
j AS (SELECT i.page, i.line, i.begins, i.everything, coalesce(max(h.label) FILTER (WHERE h.pos = i.at), CASE WHEN max(i.n) = 1 AND max(i.t0) = 'to' THEN 'NAME' END) AS label, max(h.inside) FILTER (WHERE h.pos = i.at) AS inside,
  coalesce(string_agg(h.b, ' ' ORDER BY h.pos) FILTER (WHERE h.shaped AND NOT h.phrase AND h.pos > coalesce(i.at, 0)), '') AS same FROM i JOIN h ON h.page = i.page AND h.line = i.line GROUP BY 1, 2, 3, 4),
k AS (SELECT *, CASE WHEN NOT lead(begins) OVER o THEN lead(everything) OVER o END AS nxt FROM j WINDOW o AS (PARTITION BY page ORDER BY line)),
m AS (SELECT *, label IS NOT NULL AND inside IS NULL AND same = '' AND nxt IS NOT NULL AS takes FROM k),
n AS (SELECT *, coalesce(lag(takes, 1) OVER o, false) AS t1, coalesce(lag(takes, 2) OVER o, false) AS t2, coalesce(lag(takes, 3) OVER o, false) AS t3, coalesce(lag(takes, 4) OVER o, false) AS t4 FROM m WINDOW o AS (PARTITION BY page ORDER BY line)),
r AS (SELECT *, coalesce(inside, nullif(same, ''), nxt) AS value FROM n WHERE label IS NOT NULL AND NOT (t1 AND NOT (t2 AND NOT (t3 AND NOT t4))))
SELECT page, label, string_agg(value, ' ' ORDER BY line) AS value FROM r WHERE value <> '' GROUP BY 1, 2"""


@query("words_field_values", _VALUES)
def words_field_values(spark, sf_dir):
    """Names and parents' names of pages, by labels on the line, in the segment or on the line before."""
    return documents.field_values(_words(spark, sf_dir), ["page"])


@query(
    "words_label_values",
    f"""WITH {_PAGES}, t AS (SELECT page, line, replace(l, '|', ' ') AS t, lead(replace(l, '|', ' ')) OVER (PARTITION BY page ORDER BY line) AS nxt FROM lines),
    v AS (SELECT page, label, trim(regexp_replace(t, '(?i)^\\s*(?:' || pattern || ')\\s*[:\\-]?\\s*', '')) AS rest, nxt FROM t, (VALUES ('name', 'name|नाम'), ('address', 'address')) AS p(label, pattern) WHERE regexp_matches(t, '(?i)^\\s*(?:' || pattern || ')')),
    x AS (SELECT page, label, CASE WHEN rest <> '' THEN rest WHEN NOT regexp_matches(coalesce(nxt, ''), '(?i)^(name|father|dob)') THEN nxt END AS value FROM v)
    SELECT * FROM x WHERE value IS NOT NULL""",
)
def words_label_values(spark, sf_dir):
    """The text after a label, or the next line where the label's own is empty."""
    words = _words(spark, sf_dir).withColumnRenamed("pos", "x")
    return documents.label_values(words, ["page"], {"name": "name|नाम", "address": "address"}, "^(name|father|dob)")


_NOT_NAMES = documents.NOT_NAMES  # a table of words: fixed values
_TOKENS = f"list_filter(list_transform(string_split_regex(trim(t), '\\s+'), lambda x: {_BARE}), lambda x: regexp_matches(x, '{_FORM}') AND NOT regexp_matches(x, '^[A-Za-z]{{2}}$') AND NOT (regexp_matches(x, '^[A-Za-z]{{3,}}$') AND NOT regexp_matches(x, '[AEIOUaeiou]')))"


@query(
    "text_name_lines",
    f"""WITH {_PAGES}, t AS (SELECT page, line, replace(l, '|', ' ') AS t FROM lines), n AS (SELECT *, {_TOKENS} AS ks FROM t),
    s AS (SELECT *, list_filter(ks, lambda x: regexp_matches(x, '^[A-Za-z]')) AS latin, len(list_filter(ks, lambda x: regexp_matches(x, '^[ऀ-ॿ]+$'))) > 0 AND len(list_filter(ks, lambda x: regexp_matches(x, '^[A-Za-z]'))) > 0 AS mixed FROM n)
    SELECT page, line, CASE WHEN NOT regexp_matches(lower(t), '{_NOT_NAMES}') AND len(list_filter(string_split_regex(trim(t), '\\s+'), lambda x: regexp_matches(x, '^[,.;:!?]*\\p{{Nd}}'))) = 0 AND len(string_split_regex(trim(t), '\\s+')) <= 8 AND len(ks) BETWEEN 2 AND 5 AND (NOT mixed OR len(latin) >= 2)
      THEN array_to_string(CASE WHEN mixed THEN latin ELSE ks END, ' ') END AS name FROM s""",
)
def text_name_lines(spark, sf_dir):
    """Lines that are a person's name by themselves, without their noise; null for others."""
    t = F.regexp_replace("l", "[|]", " ")
    return _lines(spark, sf_dir).select("page", "line", documents.name_shown(t).alias("name"))


_HEADERS = """h AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' ' || lower(n_name) || '  ' WHEN 1 THEN left(n_name, 2) || ' ' || substr(n_name, 3) WHEN 2 THEN left(n_name, 2) || 'x' || substr(n_name, 3) ELSE 'unknown   ' || lower(n_name) || ' zone' END AS header, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "text_headers",
    f"""WITH {_HEADERS} SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN n_name ELSE 'Unknown ' || upper(left(n_name, 1)) || lower(substr(n_name, 2)) || ' Zone' END AS name,
      CASE WHEN c_custkey % 4 < 2 THEN 'exact' WHEN c_custkey % 4 = 2 THEN 'fuzzy' ELSE 'fallback' END AS method FROM h""",
)
def text_headers(spark, sf_dir):
    """Messy headers among known ones: with blanks, with a letter too many, and unknown ones."""
    nation = table(spark, sf_dir, "nation")
    known = sorted(r.n_name for r in nation.select("n_name").distinct().collect())  # the 25 known headers
    name, kind = F.col("n_name"), F.col("c_custkey") % 4
    header = F.when(kind == 0, F.concat(F.lit(" "), F.lower(name), F.lit("  "))).when(kind == 1, F.concat(F.left(name, F.lit(2)), F.lit(" "), F.substring(name, F.lit(3), F.length(name))))
    header = header.when(kind == 2, F.concat(F.left(name, F.lit(2)), F.lit("x"), F.substring(name, F.lit(3), F.length(name)))).otherwise(F.concat(F.lit("unknown   "), F.lower(name), F.lit(" zone")))
    both = table(spark, sf_dir, "customer").join(F.broadcast(nation.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return both.select("c_custkey", text.resolve_headers(header, known).alias("r")).select("c_custkey", "r.*")


class _Sized:
    """Parts above a size are accepted; a size of 7 is an error."""

    def __init__(self, least: int):
        self.least = least

    def detect(self, page: dict) -> dict:
        if page["p_size"] == 7:
            raise ValueError("size 7")
        good = page["p_size"] >= self.least
        return {"label": "accepted" if good else "cut", "issues": [] if good else ["cut_off"], "confidence": 0.9 if good else 0.6}


def _absent():
    raise RuntimeError("no such model")


@query(
    "detector_votes",
    """SELECT p_partkey, d AS detector, d = 'sized' AND p_size <> 7 AS available, CASE WHEN d = 'sized' AND p_size <> 7 THEN CASE WHEN p_size >= 20 THEN 'accepted' ELSE 'cut' END END AS label,
      CASE WHEN d = 'sized' AND p_size <> 7 THEN CASE WHEN p_size >= 20 THEN 0.9::DOUBLE ELSE 0.6 END END AS confidence, CASE d WHEN 'sized' THEN 1.25::DOUBLE ELSE 1.0 END AS importance,
      CASE WHEN d = 'absent' THEN 'RuntimeError: no such model' WHEN p_size = 7 THEN 'ValueError: size 7' END AS error FROM part, (VALUES ('sized'), ('absent')) AS x(d)""",
)
def detector_votes(spark, sf_dir):
    """Votes of plug-ins of which one cannot be loaded; those that fail the probe are left out beforehand."""
    factories = {"sized": lambda: _Sized(20), "absent": _absent, "unknown": _absent}
    names, _ = detectors.available(list(factories), lambda n: n != "unknown", "sized")
    voted = detectors.vote(table(spark, sf_dir, "part").select("p_partkey", "p_size"), {n: factories[n] for n in names}, {"sized": 1.25})
    return voted.select("p_partkey", F.explode("votes").alias("v")).select("p_partkey", *(f"v.{c}" for c in ("detector", "available", "label", "confidence", "importance", "error")))


def _unit_price(row: dict) -> dict:
    if row["p_size"] % 5 == 0:
        raise ZeroDivisionError(f"size {row['p_size']}")
    return {"p_partkey": row["p_partkey"], "unit": round(row["p_retailprice"] / (row["p_size"] % 5), 6)}


@query(
    "entity_errors",
    """SELECT CASE WHEN p_size % 5 <> 0 THEN p_partkey END AS p_partkey, CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice / (p_size % 5), 6) END AS unit, CASE WHEN p_size % 5 = 0 THEN 'ZeroDivisionError: size ' || p_size END AS error FROM part""",
)
def entity_errors(spark, sf_dir):
    """One row for each part; where its computation fails, the error."""
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("unit", T.DoubleType())])
    return detectors.per_entity(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), _unit_price, schema)


@query(
    "gdd_at_observations",
    f"""WITH {_GDD}, o AS (SELECT o_orderkey, o_custkey % 150 AS entity_id, make_date(2024, 1, 1) + (o_orderkey % 40)::INTEGER AS d FROM orders)
    SELECT o.o_orderkey, CASE WHEN o.d < DATE '2024-01-05' THEN 0.0::DOUBLE ELSE round(c.total, 4) END AS total FROM o ASOF LEFT JOIN cum c ON o.entity_id = c.entity_id AND o.d >= c.obs_date""",
)
def gdd_at_observations(spark, sf_dir):
    """The running total at dates of observation; 0 before the start."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("entity_id"), F.expr("date_add(date '2024-01-01', cast(o_orderkey % 40 as int))").alias("obs_date"))
    found = as_of(o, _gdd(spark, sf_dir).select("entity_id", "obs_date", "total"), ["entity_id"], "obs_date", ["total"])
    return found.select("o_orderkey", F.when(F.col("obs_date") < F.lit("2024-01-05").cast("date"), 0.0).otherwise(F.round("total", 4)).alias("total"))
