"""Cells, dates, numbers and questions made of many fragments, with SQL that computes what the functions do.

The texts come from the numbers of orders by expressions that both engines read alike; the SQL restates
each rule by itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import standards, values
from lumenfold.functions.text import missing_reason, name_family, null_class, redact_url, value
from lumenfold.operators import answer
from lumenfold.plans.registry import load, query
from lumenfold.storage import spread, written


def _pick(words: list[str], every: int = 1) -> str:
    """One of the words by the order's number, the next after ``every`` orders."""
    return f"CASE CAST(floor(k / {every}) AS BIGINT) % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def _joined(*parts: str) -> str:
    return " || ".join(parts)


_TEXTS = {
    "status": _joined(_pick(["", "now ", "  was\t", "N/A "]), _pick(["de-recognised", "withdrwan", "Withdrawn", "superseded by", "replaced  by x", "suspended", "Revoked", "lapsed", "under  revision", "wip", "proposed", "to be notified", "Recognised", "empanelled", "gazetted", "in force", "inforce", "reaffirmed", "yes", "eyes", "other", "None", "null", "", "-"], 4)),
    "rule": _joined(_pick(["Mandatory", "voluntary ", "COMPULSORY", "optional", "obligatory", "see order", "", "N/A", "nil", "unknown"]), _pick(["", " or voluntary", " under  order", " .", "."], 10)),
    "licence": _joined(_pick(["licence CM/L-", "CML: ", "cm / l ", "no ", "CM-", "", "n/a", "XCML "]), _pick(["1234567", "12 34 56", "7", "12345", "98/76.", "", "letters"], 8), _pick(["", " valid", "."], 56)),
    "name": _joined(_pick(["- ", "", " .", "; "]), "p", _pick([" / ", "/", " ", " - "], 4), _pick(["co. ", "Ltd;", "x  y", "", "N/A"], 16)),
    "day": "CASE k % 13 WHEN 0 THEN y || '-' || m || '-' || d WHEN 1 THEN d || '/' || m || '/' || y WHEN 2 THEN d || '.' || m || '.' || substring(y, 3, 2) WHEN 3 THEN d || 'th ' || n || ' ' || y WHEN 4 THEN n || ' ' || d || ', ' || y WHEN 5 THEN n || ', ' || y WHEN 6 THEN y || '-' || m WHEN 7 THEN y WHEN 8 THEN 'in ' || y WHEN 9 THEN y || '/' || m || '/' || d || ' 10:20:30' WHEN 10 THEN 'n/a' WHEN 11 THEN '' ELSE ' ' || d || ' ' || n || '. ' || y || ' ' END",
}
_MONTHS = ["Jan", "february", "Mar", "APRIL", "May", "June", "Jul", "aug", "Sept", "October", "Nov", "december", "Foo"]
_BASE = f"SELECT o_orderkey AS k, o_orderpriority AS p, CAST(1885 + o_orderkey % 250 AS STRING) AS y, lpad(CAST(1 + o_orderkey % 14 AS STRING), 2, '0') AS m, CAST(1 + o_orderkey % 33 AS STRING) AS d, {_pick(_MONTHS).replace('floor(k /', 'floor(o_orderkey /')} AS n FROM orders"
_RAW = f"raw AS (SELECT k AS id, {', '.join(f'{t} AS {c}' for c, t in _TEXTS.items())} FROM ({_BASE}))"


def _based(spark, sf_dir):
    spread(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")).createOrReplaceTempView("cells_of_orders")
    return spark.sql(_BASE.replace("FROM orders", "FROM cells_of_orders"))


def _raw(spark, sf_dir):
    base = _based(spark, sf_dir)
    # written, so that functions which read a cell often don't make it anew each time
    return written(base.select(F.col("k").alias("id"), *[F.expr(t).alias(c) for c, t in _TEXTS.items()]), "cells")


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))"


def _bare(c: str) -> str:
    return f"trim(regexp_replace(lower({_squeezed(c)}), '\\.+$', ''))"


def _class(c: str) -> str:
    t = _bare(c)
    return f"CASE WHEN {_squeezed(c)} = '' OR {t} IN ('null', 'nan', 'blank', 'empty') THEN 'NULL_UNKNOWN' WHEN {t} IN ('none', 'nil', 'no', 'zero') THEN 'ASSERTED_ABSENCE' WHEN {t} IN ('na', 'n/a', '-', '?', 'unknown', 'do') THEN 'AMBIGUOUS_REQUIRES_REVIEW' ELSE 'POPULATED' END"


def _found(c: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{name}'" for p, name in rules) + f" ELSE '{otherwise}' END"


_STATUS = [
    ("de[- ]?recogni[sz]", "DERECOGNIZED"), ("with ?dr[aw][aw]n|withdrwan|withdral", "WITHDRAWN"), ("supersed|replaced by", "SUPERSEDED"), ("suspend", "SUSPENDED"), ("cancel|revok|terminat", "CANCELLED"), ("expir|lapsed", "EXPIRED"), ("draft|under (revision|development|preparation|formulation)|\\bwip\\b", "DRAFT"),
    ("propos|upcoming|forthcoming|to be notified", "PROPOSED"), ("recogni[sz]ed|accredit|empanel", "RECOGNIZED"), ("notified|gazett", "NOTIFIED"), ("\\bactive\\b|in ?force|\\bcurrent\\b|\\bvalid\\b|operational|existing|published|reaffirm|\\blive\\b|\\byes\\b", "ACTIVE"),
]
_MUST, _MAY = "regexp_matches(lower(rule), 'mandator|compulsor|obligator')", "regexp_matches(lower(rule), 'voluntar|optional')"
_MARKED = r"regexp_replace(regexp_extract(ls, '(?i)\b(?:CM\s*/?\s*L|CML)\s*[-–:/]?\s*([0-9][0-9\s./-]*[0-9]|[0-9])', 1), '[^0-9]', '', 'g')"


@query(rf"""WITH {_RAW}, c AS (SELECT *, {_squeezed('licence')} AS ls, {_class('licence')} = 'POPULATED' AS live, {_class('rule')} AS rc, {_class('name')} = 'POPULATED' AS named, {_squeezed('status')} AS ss, {_class('status')} = 'POPULATED' AS stated FROM raw),
m AS (SELECT *, {_MARKED} AS marked, regexp_extract(ls, '[0-9]{{4,}}') AS run FROM c)
SELECT id, rc AS null_class, CASE rc WHEN 'NULL_UNKNOWN' THEN 'SOURCE_CELL_EMPTY' WHEN 'ASSERTED_ABSENCE' THEN 'SOURCE_ASSERTS_ABSENCE' WHEN 'AMBIGUOUS_REQUIRES_REVIEW' THEN 'SOURCE_PLACEHOLDER_AMBIGUOUS' ELSE '' END AS reason, CASE WHEN rc = 'POPULATED' THEN {_squeezed('rule')} ELSE '' END AS value,
 CASE WHEN rc <> 'POPULATED' THEN 'UNKNOWN' WHEN {_MUST} AND {_MAY} THEN 'BOTH' WHEN {_MUST} THEN 'MANDATORY' WHEN {_MAY} THEN 'VOLUNTARY' ELSE 'OTHER' END AS mandatory,
 CASE WHEN NOT live THEN '' WHEN marked <> '' THEN 'CM/L-' || marked WHEN run <> '' THEN 'CM/L-' || run ELSE ls END AS licence_no, CASE WHEN NOT live THEN 'EMPTY' WHEN marked <> '' THEN 'CML' WHEN run <> '' THEN 'DIGITS_ONLY' ELSE 'LABEL' END AS licence_class,
 CASE WHEN named THEN regexp_replace(regexp_replace(regexp_replace({_squeezed('name')}, '\s*/\s*', '/', 'g'), '^[ .;,-]+|[ .;,-]+$', '', 'g'), '\s+', ' ', 'g') ELSE '' END AS name, CASE WHEN stated THEN {_found('lower(ss)', _STATUS, 'OTHER')} ELSE 'UNKNOWN' END AS status FROM m""")
def computed_cells(spark, sf_dir):
    found = values.nlicence(F.col("licence"))
    rule = null_class(F.col("rule"))
    return _raw(spark, sf_dir).select(
        "id", rule.alias("null_class"), missing_reason(rule).alias("reason"), value(F.col("rule")).alias("value"), values.nmandatory(F.col("rule")).alias("mandatory"), found["licence_no"].alias("licence_no"), found["cls"].alias("licence_class"), values.nname(F.col("name")).alias("name"),
        values.nstatus(F.col("status"))["status"].alias("status"),
    )


_MONTH = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], left(lower({w}), 3))"


def _date(y: str, m: str, d: str) -> str:
    return f"CASE WHEN TRY_CAST({y} AS INT) BETWEEN 1900 AND 2100 AND TRY_CAST({m} AS INT) BETWEEN 1 AND 12 AND TRY_CAST({d} AS INT) BETWEEN 1 AND 31 THEN lpad(CAST(TRY_CAST({y} AS INT) AS VARCHAR), 4, '0') || '-' || lpad(CAST(TRY_CAST({m} AS INT) AS VARCHAR), 2, '0') || '-' || lpad(CAST(TRY_CAST({d} AS INT) AS VARCHAR), 2, '0') ELSE '' END"


_DAYS = [
    ("iso", r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})"), ("num", r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})$"), ("dmy", r"^([0-9]{1,2})(?:st|nd|rd|th)?[ -]([A-Za-z]{3,9})\.?,?[ -]([0-9]{4})$"), ("mdy", r"^([A-Za-z]{3,9})\.?[ -]([0-9]{1,2})(?:st|nd|rd|th)?,?[ -]([0-9]{4})$"),
    ("my", r"^([A-Za-z]{3,9})\.?[ ,-]*([0-9]{4})$"), ("ym", r"^([0-9]{4})[-/.]([0-9]{1,2})$"),
]
_PARTS = ", ".join(f"regexp_matches(s, '{p}') AS {n}, regexp_extract(s, '{p}', 1) AS {n}1, regexp_extract(s, '{p}', 2) AS {n}2" + (f", regexp_extract(s, '{p}', 3) AS {n}3" if n not in ("my", "ym") else "") for n, p in _DAYS)


@query(rf"""WITH {_RAW}, s AS (SELECT id, {_class('day')} = 'POPULATED' AS live, trim(regexp_replace({_squeezed('day')}, '[ T][0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?(\.[0-9]+)?$', '')) AS s FROM raw), p AS (SELECT *, {_PARTS} FROM s),
f AS (SELECT *, TRY_CAST(num1 AS INT) <= 12 AND TRY_CAST(num2 AS INT) > 12 AS swapped, CASE WHEN length(num3) = 2 THEN (CASE WHEN TRY_CAST(num3 AS INT) < 50 THEN '20' ELSE '19' END) || num3 ELSE num3 END AS year, {_MONTH.format(w='dmy2')} AS dm, {_MONTH.format(w='mdy1')} AS mm, {_MONTH.format(w='my1')} AS ym_m FROM p),
d AS (SELECT *, CASE WHEN iso THEN {_date('iso1', 'iso2', 'iso3')} WHEN num THEN (CASE WHEN swapped THEN {_date('year', 'num1', 'num2')} ELSE {_date('year', 'num2', 'num1')} END) WHEN dmy THEN {_date('dmy3', 'greatest(coalesce(dm, 0), 1)', 'dmy1')} WHEN mdy AND coalesce(mm, 0) > 0 THEN {_date('mdy3', 'mm', 'mdy2')} END AS day FROM f),
g AS (SELECT *, CASE WHEN day IS NOT NULL THEN day WHEN ym AND TRY_CAST(ym2 AS INT) BETWEEN 1 AND 12 THEN ym1 || '-' || lpad(CAST(TRY_CAST(ym2 AS INT) AS VARCHAR), 2, '0') WHEN NOT ym AND my AND coalesce(ym_m, 0) > 0 THEN my2 || '-' || lpad(CAST(ym_m AS VARCHAR), 2, '0') WHEN regexp_matches(s, '^(?:19|20)[0-9][0-9]$') THEN s ELSE '' END AS found FROM d)
SELECT id, CASE WHEN live THEN found ELSE '' END AS iso, CASE WHEN NOT live THEN '' WHEN found = '' THEN 'NONE' WHEN day IS NOT NULL THEN 'DAY' WHEN length(found) = 7 THEN 'MONTH' ELSE 'YEAR' END AS precision,
 CASE WHEN NOT live THEN '' WHEN found = '' THEN 'UNPARSED_PRESERVED' WHEN NOT iso AND num AND TRY_CAST(num1 AS INT) <= 12 AND TRY_CAST(num2 AS INT) <= 12 THEN 'AMBIGUOUS_DMY' ELSE '' END AS flag FROM g""")
def computed_dates(spark, sf_dir):
    return _raw(spark, sf_dir).select("id", values.ndate(F.col("day")).alias("d")).select("id", "d.iso", "d.precision", "d.flag")


#: Texts with standard numbers in many forms.
_NUMBERED = _joined(_pick(["as per ", "", "see (", "THIS ", "is not "]), _pick(["IS:302", "IS 302", "is/iec 60335", "IS / ISO 9001", "IS-1786", "IS 10500-2", "IS/IEC 60335-2", "none", "IS"], 5), _pick(["", " (Part 2)", " pt 3A", " Part. 1 (Sec 4)"], 45), _pick(["", ": 2008", "/1999", ", Amd No. 2", " : 2015 Amendment 1", ":1850"], 7), _pick(["", " and IS 302", "; IS 00456:2000", ") or IS 302 (part 2)"], 11))
_IS = r"(?i)(?:^|[^A-Za-z0-9])IS(\s*/\s*(?:IEC|ISO))?[\s:-]{0,3}([0-9]{1,5})(-[0-9]{1,3})?(?:\s*\(?\s*(?:Part|Pt)\.?\s*([0-9]+[A-Za-z]?)\s*\)?)?(?:\s*\(?\s*(?:Sec|Section)\.?\s*([0-9]+)\s*\)?)?(?:\s*[:/-]\s*((?:19|20)[0-9]{2}))?(?:\s*[,;]?\s*(?:Amd|Amdt|Amendment)\.?\s*(?:No\.?\s*)?([0-9]+))?"


def _group(i: int) -> str:
    return f"coalesce(regexp_extract(hit, '{_IS}', {i}), '')"


@query(rf"""WITH t AS (SELECT k AS id, {_NUMBERED} AS text FROM ({_BASE})), hits AS (SELECT id, unnest(h) AS hit, unnest(range(1, len(h) + 1)) AS i FROM (SELECT id, regexp_extract_all({_squeezed('text')}, '{_IS}') AS h FROM t)),
p AS (SELECT id, i, upper(regexp_replace({_group(1)}, '\s', '', 'g')) AS body, regexp_replace({_group(2)}, '^0+', '') AS number, {_group(3)} AS dash, upper({_group(4)}) AS part, {_group(5)} AS section, {_group(6)} AS year, {_group(7)} AS amendment FROM hits),
q AS (SELECT id, i, year, amendment, 'IS' || body || ' ' || (CASE WHEN number = '' THEN '0' ELSE number END) || (CASE WHEN dash <> '' AND (body <> '' OR part <> '') THEN dash ELSE '' END) || (CASE WHEN part <> '' THEN ' (Part ' || part || ')' WHEN dash <> '' AND body = '' THEN ' (Part ' || dash[2:] || ')' ELSE '' END) || (CASE WHEN section <> '' THEN ' (Sec ' || section || ')' ELSE '' END) AS canonical FROM p),
f AS (SELECT id, count(*) AS n, arg_min(canonical, i) AS first, count(DISTINCT canonical) AS n_distinct, string_agg(year || '/' || amendment, ',' ORDER BY i) AS years FROM q GROUP BY 1)
SELECT t.id, coalesce(first, '') AS first, CASE WHEN {_class('text')} <> 'POPULATED' THEN 'EMPTY' WHEN n IS NULL THEN 'NO_REFERENCE' WHEN n = 1 THEN 'PARSED' ELSE 'PARSED_FIRST_OF_' || n END AS status, coalesce(n_distinct, 0)::INTEGER AS n_distinct, coalesce(years, '') AS years FROM t LEFT JOIN f ON f.id = t.id""")
def computed_numbers(spark, sf_dir):
    rows = _based(spark, sf_dir).select(F.col("k").alias("id"), F.expr(_NUMBERED).alias("text"))
    text = F.col("text")
    years = F.array_join(F.transform(standards.parse_numbers(text), lambda x: F.concat(x["year"], F.lit("/"), x["amendment"])), ",")
    made = rows.select("id", standards.first_number(text).alias("f"), F.size(standards.distinct_numbers(text)).alias("n_distinct"), years.alias("years"))
    return made.select("id", F.col("f.canonical").alias("first"), "f.status", "n_distinct", "years")


#: Questions of many fragments.
_ASKED = _joined(_pick(["", "Compare ", "please verify ", "I manufacture ", "what ", "which standard for ", "all bis "]), _pick(["IS 302 ", "chair ", "IS 302 and IS 456:2000 ", "cement ", "", "QCO 12 ", "licence 7700-A1 ", "widgets ", "is it ok "], 7), _pick(["tests", "laboratories", "scheme ii", "compliance", "manual", "certification", "apply", "labs and testing", "", "pathway", "document comparison"], 63))
_NO = "'what', 'which', 'who', 'where', 'when', 'is', 'are', 'the', 'a', 'an', 'of', 'for', 'to', 'and', 'apply', 'applies', 'required', 'require', 'relevant', 'can', 'perform', 'do', 'them', 'my', 'me', 'tell', 'show', 'give', 'this', 'that', 'these', 'those', 'tests', 'test', 'testing', 'laboratory', 'laboratories', 'labs', 'indian', 'standard', 'bis', 'certification', 'mandatory', 'scheme', 'quality', 'control', 'order', 'licence', 'license', 'applicable', 'supporting', 'evidence'"


def _holds(*words: str) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


_MARKS = " + ".join(f"contains(low, '{w}')::INT" for w in ["manufactur", "requirements", "compliance", "pathway", "which scheme", "mandatory", "labs or laboratories", "and show", "all bis"])
_HINT = _holds("manufactur", "make", "produce", "product", "chair", "cooker", "pressure cooker", "cement", "steel", "paint", "toy", "led", "household", "furniture")


@query(rf"""WITH t AS (SELECT k AS id, {_ASKED} AS text FROM ({_BASE})), l AS (SELECT *, lower(text) AS low, regexp_extract_all(text, '(?i)\bIS\s*[:-]?\s*([0-9]{{2,6}})(?:\s*[:-]\s*([0-9]{{4}}))?', 1) AS ns FROM t),
e AS (SELECT *, len(ns) AS n, regexp_matches(low, '\bcompar\w+\b') OR len(ns) >= 2 AS compared, {_holds('test')} AS tests, {_holds('lab', 'laboratory', 'laboratories')} AS labs, {_HINT} AS hint, {_MARKS} AS marks, regexp_matches(text, '(?i)\bQCO[ :-]*([0-9]{{1,4}})\b') AS qco,
  {_holds('scheme i', 'fmcs', 'isi mark', 'registration scheme', 'hallmarking scheme', 'conformity assessment')} AS schemed, array_to_string(list_filter(regexp_extract_all(low, '[a-z0-9-]+'), lambda w: length(w) >= 3 AND w NOT IN ({_NO}))[1:6], ' ') AS words FROM l),
p AS (SELECT *, CASE WHEN (hint OR n = 0) AND words <> '' THEN words END AS product FROM e),
k AS (SELECT id, product, array_to_string(ns, ',') AS numbers, CASE WHEN compared AND n >= 2 THEN 'COMPARISON' WHEN regexp_matches(low, '\b(?:verify|licence|license|cml|huid|registration no)\b') THEN 'VERIFICATION' WHEN marks >= 2 OR (hint AND marks >= 1) OR (contains(low, 'manufactur') AND tests) THEN 'COMPLIANCE_WORKFLOW' WHEN labs AND NOT tests THEN 'LAB_LOOKUP' WHEN tests THEN 'TEST_LOOKUP'
  WHEN qco THEN 'QCO_LOOKUP' WHEN schemed THEN 'SCHEME_LOOKUP' WHEN n > 0 AND product IS NULL THEN 'SIMPLE_LOOKUP' WHEN product IS NOT NULL AND n = 0 AND {_holds('standard', 'apply', 'applies', 'which')} THEN 'STANDARD_DISCOVERY' WHEN product IS NOT NULL AND n = 0 THEN 'PRODUCT_DISCOVERY' WHEN contains(low, 'compare') THEN 'COMPARISON'
  WHEN {_holds('document', 'manual')} THEN 'DOCUMENT_RESEARCH' WHEN contains(low, 'certif') AND product IS NOT NULL THEN 'CERTIFICATION_GUIDANCE' ELSE 'GENERAL_BIS' END AS task FROM p)
SELECT id, numbers, product AS product_text, task, CASE WHEN task IN ('COMPLIANCE_WORKFLOW', 'COMPARISON', 'VERIFICATION', 'CERTIFICATION_GUIDANCE', 'DOCUMENT_RESEARCH', 'STANDARD_DISCOVERY') THEN 'AGENT' ELSE 'SIMPLE' END AS mode FROM k""")
def computed_intents(spark, sf_dir):
    asked = _based(spark, sf_dir).select(F.col("k").alias("id"), F.expr(_ASKED).alias("text"))
    return answer.classify_task(answer.extract_entities(asked)).select("id", "numbers", "product_text", "task", "mode")


#: Packed cells: order numbers with dates, scopes, names with addresses, entities, file names, links.
_PACKED = {
    "numbered": _joined(_pick(["S.O. 123(E)", "GSR 45", "No. 7/2019", "order of the state", "", "N/A", "so  99-A"]), _pick([" dated 5 May 2020", " (01/02/2019)", ", 12-03-2021", " issued on: 2018", "", " w.e.f. 1 June 2019.", " (2017-2018)"], 7), _pick(["", " extra"], 49)),
    "scope": _joined(_pick(["Covers S.O. papers. ", "Applies to Co. Ltd. works; ", "No exclusions apply. ", ""]), _pick(["Excluding toys made by hand. ", "Amended by order 5. ", "It shall not apply to exports. ", "Plain words here; more words. ", "n/a"], 4), _pick(["Other than cable.", "Superseded in 2010.", "The end", ""], 20)),
    "maker": _joined(_pick(["Northern Works Pvt. Ltd.", "Acme Industries", "J. Doe", "", "Beta Co", "nil"]), _pick([", 5 Mill Lane, Pune", " | Address: 7 High St, | City: Delhi | Country: India", "", " | city : Goa", ", Unit 2"], 6)),
    "entity": _joined(_pick(["Steel Pipes", "Cement (OPC)", "n/a", "Paint"]), _pick(["; ", " and ", "/", ", ", " | "], 4), _pick(["pumps", "STEEL  pipes!", "x", "", "unknown"], 20)),
    "file": _joined(_pick(["Data Set", "qco_list", "Report"]), _pick(["", "_v2", " (3)", "-final", " copy", "_2020-01-05", "_version 1.2"], 3), _pick([".csv", ".XLSX", ""], 21)),
    "link": _joined(_pick(["https://", "postgres://", ""]), _pick(["user:secret@", "", "name@"], 3), "'host.org/x'"),
}
_CUED, _BRACKET = r"(?i)\b(?:date[sd]?|dt\.?|w\.?e\.?f\.?|with effect from|published on|issued on|notified on)\b[: ]*", r"\(([0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{4}(?:\s*[/&-]\s*[0-9]{4})?)\)"
_TRAIL, _ORDER = r"[,;(\[ ]\s*((?:[0-9]{1,2}[-/. ])?(?:[0-9]{1,2}|[A-Za-z]{3,9})[-/. ,]*[0-9]{4})\s*[)\]]?\s*$", r"(?i)(?:S\.?\s*O\.?|G\.?\s*S\.?\s*R\.?|CG-DL-E|\bNo\.?)\s*[-:]?\s*[0-9][A-Za-z0-9_()./-]*"
_ORG = r"\b(?:pvt|private|ltd|limited|inc|llc|llp|gmbh|co\.?|corp(?:oration)?|company|industr(?:y|ies)|enterprises?|technolog(?:y|ies)|manufactur\w*|group|holdings?|plc|srl|sas|pte)\b\.?"
_AMENDED, _EXCLUDED, _NEGATED = r"(?i)\b(?:amend\w*|corrigend(?:um|a)|supersed\w+|revised by|substituted by)\b", r"(?i)\b(?:exclusions?|excludes?|excluding|exempt(?:ed|ions?)?|not applicable to|shall not apply to|other than)\b", r"(?i)\b(?:no|none|nil|without|not any|zero)\s+(?:\w+\s+){0,3}?(?:exclusions?|exemptions?)\b"


def _trimmed(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^[ ,;:\-–(\[/)\]]+|[ ,;:\-–(\[/]+$', '', 'g'), '\s{{2,}}', ' ', 'g')"


def _shown(c: str) -> str:
    return f"CASE WHEN {_class(c)} = 'POPULATED' THEN {c} ELSE '' END"


_LABEL = r"regexp_replace(trim(regexp_extract(ms, '(?i)\|\s*{name}\s*:([^|]*)', 1)), '[ ,;]+$', '')"
_LABELS = r"(?i)\|\s*(?:address|city|country|state|pin|postal code|zip)\s*:"


@query(rf"""WITH raw AS (SELECT k AS id, {', '.join(f'{t} AS {c}' for c, t in _PACKED.items())} FROM ({_BASE})),
a AS (SELECT *, {_squeezed('numbered')} AS ns, {_class('numbered')} = 'POPULATED' AS nlive, {_squeezed('maker')} AS ms, {_class('maker')} = 'POPULATED' AS mlive, {_class('scope')} = 'POPULATED' AS slive, regexp_replace(regexp_replace({_squeezed('scope')}, '(S\.O|Co|Ltd|Pvt)\.', '\1' || chr(2), 'g'), '([.;])\s+', '\1' || chr(1), 'g') AS marked FROM raw),
b AS (SELECT *, CASE WHEN NOT nlive THEN 'EMPTY' WHEN regexp_extract(ns, '{_CUED}') <> '' THEN 'DATE_CUE' WHEN regexp_extract(ns, '{_BRACKET}', 1) <> '' THEN 'PAREN_DATE' WHEN regexp_extract(ns, '{_TRAIL}', 1) <> '' THEN 'TRAIL_DATE' ELSE 'NO_CUE' END AS method,
  CASE WHEN slive THEN list_transform(string_split(marked, chr(1)), lambda x: trim(replace(x, chr(2), '.'))) ELSE [] END AS sentences, regexp_matches(ms, '{_LABELS}') AS labelled, regexp_matches(ms, '(?i)^(.*{_ORG}[^,]*),(.*)$') AS by_org FROM a),
c AS (SELECT *, CASE method WHEN 'DATE_CUE' THEN regexp_extract(ns, '^(.*?){_CUED}', 1) WHEN 'PAREN_DATE' THEN regexp_replace(ns, '{_BRACKET}', ' ', 'g') WHEN 'TRAIL_DATE' THEN regexp_replace(ns, '{_TRAIL}', '') ELSE ns END AS head,
  list_filter(sentences, lambda x: regexp_matches(x, '{_AMENDED}')) AS am, list_filter(sentences, lambda x: NOT regexp_matches(x, '{_AMENDED}') AND regexp_matches(x, '{_EXCLUDED}') AND NOT regexp_matches(x, '{_NEGATED}')) AS ex FROM b)
SELECT id, method, regexp_extract(head, '{_ORDER}') AS number, {_trimmed(f"regexp_replace(head, '{_ORDER}', ' ', 'g')")} AS note, {_trimmed(f"CASE method WHEN 'DATE_CUE' THEN regexp_extract(ns, '{_CUED}(.*)$', 1) WHEN 'PAREN_DATE' THEN regexp_extract(ns, '{_BRACKET}', 1) WHEN 'TRAIL_DATE' THEN regexp_extract(ns, '{_TRAIL}', 1) ELSE '' END")} AS date_text,
 array_to_string(list_filter(sentences, lambda x: NOT list_contains(am, x) AND NOT list_contains(ex, x)), ' ') AS scope, array_to_string(ex, ' ') AS exclusions, array_to_string(am, ' ') AS amendments,
 CASE WHEN NOT mlive THEN 'EMPTY' WHEN labelled THEN 'LABELLED' WHEN by_org THEN 'ORG_TOKEN_COMMA' WHEN regexp_matches(ms, '(?i){_ORG}') THEN 'ORG_TOKEN_NO_COMMA' ELSE 'NO_LABEL_NO_ORG_TOKEN' END AS maker_method,
 CASE WHEN NOT mlive THEN '' WHEN labelled THEN regexp_replace(regexp_extract(ms, '(?i)^(.*?)\|\s*(?:address|city|country|state|pin|postal code|zip)\s*:', 1), '[ ,;|]+$', '') WHEN by_org THEN trim(regexp_extract(ms, '(?i)^(.*{_ORG}[^,]*),(.*)$', 1)) ELSE ms END AS maker,
 CASE WHEN NOT mlive THEN '' WHEN labelled THEN {_shown(_LABEL.format(name='address'))} WHEN by_org THEN trim(regexp_extract(ms, '(?i)^(.*{_ORG}[^,]*),(.*)$', 2)) ELSE '' END AS address, CASE WHEN labelled THEN {_shown(_LABEL.format(name='city'))} ELSE '' END AS city,
 array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex({_squeezed('entity')}, '(?i)[;,|/]+|\band\b'), lambda x: trim(regexp_replace(lower(x), '[^0-9a-z]+', ' ', 'g'))), lambda x: length(x) > 1 AND x NOT IN ('unknown', 'none', 'null', 'nil', 'na', 'no')))), '|') AS entities,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(file), '\.[a-z0-9]{{1,5}}$', ''), '\([0-9]+\)|[_ -]*(?:copy|final|v(?:er(?:sion)?)?[_ -]?[0-9.]+|[0-9]{{4}}[-_]?[0-9]{{2}}[-_]?[0-9]{{2}})', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS family,
 CASE WHEN regexp_matches(link, '://[^/@]*@') THEN split_part(link, '://', 1) || '://***@host.org/x' ELSE link END AS link FROM c""")
def computed_packed(spark, sf_dir):
    raw = written(_based(spark, sf_dir).select(F.col("k").alias("id"), *[F.expr(t).alias(c) for c, t in _PACKED.items()]), "cells")
    made = raw.select("id", standards.split_number_and_date(F.col("numbered")).alias("n"), standards.split_scope(F.col("scope")).alias("s"), standards.split_name_and_address(F.col("maker")).alias("m"), F.array_join(standards.norm_entity("PRODUCT", F.col("entity")), "|").alias("entities"), name_family(F.col("file")).alias("family"), redact_url(F.col("link")).alias("link"))
    return made.select("id", "n.method", "n.number", "n.note", "n.date_text", "s.scope", "s.exclusions", "s.amendments", F.col("m.method").alias("maker_method"), F.col("m.name").alias("maker"), "m.address", "m.city", "entities", "family", "link")
