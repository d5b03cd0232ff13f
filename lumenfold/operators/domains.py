"""What a file is about: domains scored by its headers, its name, its values and its scheme columns, from a table of rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import let
from lumenfold.storage import BROADCAST_BYTES, spread, written


def whole(pattern: str) -> str:
    """The pattern with no letter or digit on either side; an underscore counts as a gap."""
    return f"(?<![a-z0-9])(?:{pattern})(?![a-z0-9])"


# Domains, each with patterns of headers, and patterns of file names and values.
DOMAINS = [
    ("01_KNOW_YOUR_STANDARD", ["^standard_id$", "^is_number$|^is$|^is number$", "reaffirmation", "technical_committee", "^revision$", "superseding_standard", "superseded_standard", "amendment_number", "^publication_date$", "parent_entity", "^part_section$"], ["standards_details", "standards_amendments", "gazette", "know_your_standard"]),
    ("02_PRODUCTS", ["^product_id$", "alternate_names", "^subcategory$", "^keywords$", "related_is_numbers", "related_qcos", "related_schemes"], ["products_details", "products_full_information"]),
    ("03_QCO", ["^qco_(id|no|number|name|reference)", "quality_control_order", "mandatory_status", "^notification_(no|number)", "^effective_date$", "exclusions", "qco_order"], ["qco", "quality control order", "गुणवत्ता नियंत्रण", "आदेश"]),
    ("04_SCHEME_I", [], [whole("scheme[_\\-. ]?(?:1|i)"), "isi\\s*mark"]),
    ("05_SCHEME_II_CRS", [], [whole("scheme[_\\-. ]?(?:2|ii)"), whole("crs"), "compulsory registration"]),
    ("06_SCHEME_IV_COC", [], [whole("scheme[_\\-. ]?(?:4|iv)"), "certificate of conformity", whole("coc")]),
    ("07_SCHEME_X", [], [whole("scheme[_\\-. ]?(?:x|10)"), whole("eeqco"), "omnibus technical regulation"]),
    ("08_PRODUCT_SPECIFIC", ["factory_requirements", "infrastructure_requirements", "process_controls", "conformity_assessment", "competent_personnel", "^eligibility$", "required_documents", "quality_control"], ["standards_intelligence", "scheme_mapping"]),
    ("09_PRODUCT_MANUALS", ["^manual_id$", "^manual_title$", "sampling_guidelines", "marking_requirements", "raw_material_requirements", "process_requirements"], ["product_manual"]),
    ("10_TESTING", ["^test_id$", "^test_name$", "^test_parameter$", "acceptance_criteria", "^test_method$", "sampling_frequency", "required_equipment", "rejection_handling", "^parameter$", "^sample_size$"], ["testing_master", "testing_parameters", "combined_testing"]),
    ("11_CERTIFICATION_PROCESS", ["application_procedure", "fee_structure", "inspection_testing_norm", "^applicability$", "guideline_title", "application_requirements", "^air$"], ["product_certifications", "certification.*process|licensing procedure"]),
    ("12_CERTIFICATION_FAQ", ["^faq_id$", "^question$", "^answer$"], ["faq"]),
    ("13_LAB_SERVICES", ["testing_charge", "^capability$", "scope_status", "scope_validity"], ["laboratory_scopes", "lab.*services"]),
    ("14_LIMS_LABS", ["^lab_id$", "^lab_name$", "^lab_code$", "^lab_type$", "accreditation_validity", "recognition_status"], ["laborator", "recognized_lab", whole("lims")]),
    ("15_LIMS_IS_TEST", ["^scope_id$"], ["laboratory_scopes"]),
    ("16_ACT_RULES_REGULATIONS", ["^circular_id$", "^circular_number$", "^notification_id$", "issuing_authority", "implementation_instructions", "related_amendment", "^ministry$", "^gazette"], ["circular", "gazette", "notification", whole("act|rules|regulation"), "अधिसूचना", "राजपत्र", "एस\\.?ओ\\.?"]),
    ("17_HALLMARKING_OVERVIEW", [], ["hallmark", whole("huid"), "assaying", "हॉलमार्क"]),
    ("18_HALLMARKING_FAQ", ["^question$", "^answer$"], ["hallmark.*faq"]),
    ("19_HALLMARKING_ORDERS", ["^order_id$", "^fineness$", "^metal$", "district_phase", "geographical_applicability", "^supersession$"], ["hallmarking_order", "mandatory_hallmarking"]),
    ("20_HALLMARKING_CENTRES", ["^centre_id$", "^centre_code$", "^centre_name$", "^centre_type$", "recognition_status_raw", "suspended_cancelled_date"], ["hallmarking_centre", whole("ahc"), "assaying & hallmarking"]),
    ("21_JEWELLER_REGISTRATION", [], ["jewell", "registered jeweller", "jeweller registration"]),
    ("22_FMCS", ["^cml_no_raw$|^cml_no$", "^manufacturer_id$", "^country$", "^licence_status$", "manufacturer_count", "licence_count", "name_address_raw"], [whole("fmcs"), "foreign manufacturer"]),
]
# Patterns of file names that speak for a domain, with their points.
NAME_SIGNALS = [("provenance|source_inventory|extraction_log|unresolved_records|source_conflicts", "OTHER_RELEVANT", 9), ("official_documents", "OTHER_RELEVANT", 4)]
# What names a scheme in a cell, the most specific first, and which columns identify a scheme, with their rank.
SCHEME_TOKENS = [
    ("FMCS|FOREIGN MANUFACTURER", "22_FMCS"),
    ("SCHEME\\s*[-–—:_]?\\s*IV(?![A-Z0-9])|SCHEME 4(?![A-Z0-9])|SCH[-_ ]?IV(?![A-Z0-9])", "06_SCHEME_IV_COC"),
    ("SCHEME\\s*[-–—:_]?\\s*II(?![A-Z0-9])|SCHEME 2(?![A-Z0-9])|SCH[-_ ]?II(?![A-Z0-9])|\\bCRS\\b|COMPULSORY REGISTRATION", "05_SCHEME_II_CRS"),
    ("SCHEME\\s*[-–—:_]?\\s*X(?![A-Z0-9])|SCHEME 10(?![A-Z0-9])|SCH[-_ ]?X(?![A-Z0-9])|\\bEEQCO\\b", "07_SCHEME_X"),
    ("SCHEME\\s*[-–—:_]?\\s*I(?![IVX0-9])|SCHEME 1(?![0-9])|SCH[-_ ]?I(?![IVX0-9])|ISI MARK", "04_SCHEME_I"),
]
SCHEME_COLUMNS = [("^scheme(_(name|label|title))$", 3), ("^(scheme|schemes|scheme_id|scheme_code|scheme_id_code|scheme_no|scheme_number|scheme_record_id)$", 2), ("^scheme_(type|status)$", 1)]
_POINTS = "array<struct<domain:string,score:bigint>>"
HEADER, VALUE, STRONG, BLENDED, SECOND, LEAST, MOST = 3, 2, 7, 5, 3, 5, 4


def _first(c: Column, rules: list[tuple], otherwise: Column) -> Column:
    return reduce(lambda w, r: w.when(c.rlike(r[0]), r[1]), rules, F.when(F.lit(False), otherwise)).otherwise(otherwise)


def _once(rows: DataFrame, column: str, made: Callable[[Column], Column], name: str) -> DataFrame:
    """``rows`` with ``made`` of a column without nulls: made once of each different value, if these fit, else in each row."""
    values = written(rows.select(column).distinct(), "values")
    size = values.agg(F.sum(F.length(F.concat_ws(" ", column)) + 256)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return rows.withColumn(name, made(F.col(column)))
    facts = written(spread(values).withColumn(name, made(F.col(column))), "facts")  # a table, or filters on it would be made in each row
    return rows.join(F.broadcast(facts), column)


def dominant_schemes(cells: DataFrame, share: float = 0.6, hits: int = 3) -> DataFrame:
    """(file_id, domain, points) from cells (file_id, header, value, n), n being how often a value occurs.

    In each column that identifies a scheme the label of most cells counts, if it has ``share`` of those
    with any label, and ``hits`` cells or half of all. That of the best column gets 7 points, or 5 if the
    column only blends schemes; other labels that dominate a column get 3.
    """
    label = lambda c: let(F.upper(F.regexp_replace(c, "\\s+", " ")), lambda v: _first(v, SCHEME_TOKENS, F.lit(None)))
    named = _once(cells.select("file_id", "header", F.coalesce("value", F.lit("")).alias("value"), "n").where("header IS NOT NULL"), "header", lambda c: _first(c, SCHEME_COLUMNS, F.lit(0)), "rank")
    marked = _once(named.where("rank > 0"), "value", label, "domain")
    counted = marked.groupBy("file_id", "header", "rank", "domain").agg(F.sum("n").alias("n")).repartition("file_id")  # what follows is within a file
    column = Window.partitionBy("file_id", "header")  # a row a label
    known = F.col("domain").isNotNull()
    facts = counted.withColumns({"all": F.sum("n").over(column), "bearing": F.sum(F.when(known, F.col("n"))).over(column), "nth": F.row_number().over(column.orderBy(F.desc(known), F.desc("n"), "domain"))})
    best = facts.where(known & (F.col("nth") == 1) & (F.col("n") >= share * F.col("bearing")) & ((F.col("n") >= hits) | (F.col("n") >= 0.5 * F.col("all"))))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("rank"), F.desc("n"), "header")))  # a row a column
    one = placed.groupBy("file_id", "domain").agg(F.min(F.struct("place", "rank")).alias("x"))
    points = F.when(F.col("x.place") > 1, SECOND).when(F.col("x.rank") >= 2, STRONG).otherwise(BLENDED)
    return one.select("file_id", "domain", points.alias("points"))


def _points(domain: str, points: Column | int) -> Column:
    return F.struct(F.lit(domain).alias("domain"), F.lit(points).cast("long").alias("score"))


def domain_scores(files: DataFrame, schemes: DataFrame | None = None, domains: list = DOMAINS, signals: list = NAME_SIGNALS) -> DataFrame:
    """(file_id, domain, score) of each domain that files (file_id, name, headers, sample) score in.

    Three points for each different header that a pattern finds, two for each pattern that the name or
    else the sample of values holds, those of the name's signals and of ``schemes`` (file_id, domain, points).
    Files share names, headers and samples: each different one is held against the patterns once.
    """
    patterns = [(d, p) for d, _, values in domains for p in values]
    ask = [(d, "|".join(f"(?:{x})" for x in heads)) for d, heads, _ in domains if heads]
    held = lambda c: F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(i)) for i, (_, p) in enumerate(patterns)]).cast("array<int>"))
    heads = lambda c: F.filter(F.array(*[_points(d, HEADER * F.size(F.filter(c, lambda h: h.rlike(p)))) for d, p in ask]).cast(_POINTS), lambda x: x["score"] > 0)  # noqa: B023, E731
    signal = lambda c: F.array_compact(F.array(*[F.when(c.rlike(p), _points(d, n)) for p, d, n in signals]).cast(_POINTS))
    slim = files.select("file_id", F.lower(F.coalesce("name", F.lit(""))).alias("name"), F.lower(F.coalesce("sample", F.lit(""))).alias("sample"), F.array_distinct(F.coalesce("headers", F.array().cast("array<string>"))).alias("headers"))
    of_name = lambda c: F.struct(held(c).alias("held"), signal(c).alias("signal"))
    rows = _once(_once(_once(slim, "name", of_name, "named"), "sample", held, "sampled"), "headers", heads, "headed")
    value = F.array(*[_points(d, VALUE) for d, _ in patterns]).cast(_POINTS)
    values = F.transform(F.array_union("named.held", "sampled"), lambda i: F.get(value, i))
    each = rows.select("file_id", F.explode(F.concat(values, "headed", "named.signal")).alias("x")).select("file_id", "x.*")
    if schemes is not None:
        each = each.unionByName(schemes.select("file_id", "domain", F.col("points").cast("long").alias("score")))
    return each.groupBy("file_id", "domain").agg(F.sum("score").alias("score"))


def file_domains(files: DataFrame, scores: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(file_id, domain, secondary, score): the best domain of each file, and up to ``most`` others that reach ``least``.

    A file whose best is below ``least`` is UNKNOWN, with its three best as secondary; of equal scores
    the first domain by name leads.
    """
    ranked = scores.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "domain"))).alias("all"))  # a row a domain
    names = lambda a: F.array_join(F.transform(a, lambda x: x["domain"]), ";")
    top = -F.col("all")[0]["order"]
    rest = F.slice(F.filter(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), lambda x: -x["order"] >= least), 1, most)
    sure = top >= least
    made = ranked.select("file_id", F.when(sure, F.col("all")[0]["domain"]).otherwise("UNKNOWN").alias("domain"), F.when(sure, names(rest)).otherwise(names(F.slice("all", 1, 3))).alias("secondary"), top.alias("score"))
    out = files.select("file_id").join(made, "file_id", "left")
    return out.select("file_id", F.coalesce("domain", F.lit("UNKNOWN")).alias("domain"), F.coalesce("secondary", F.lit("")).alias("secondary"), F.coalesce("score", F.lit(0)).alias("score"))
