"""Composite standard numbers, licences and packed cells, parsed by Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import let, populated, squeeze, strip

# Fixed value: the parts of a standard number, in order: body, number, dash, part, section, year, amendment.
NUMBER = (
    "(?i)(?<![A-Za-z0-9])IS(\\s*/\\s*(?:IEC\\s*/\\s*ISO|ISO\\s*/\\s*IEC|IEC|ISO))?[\\s:-]{0,3}([0-9]{1,5})(-[0-9]{1,3}(?![0-9]))?"
    "(?:\\s*\\(?\\s*(?:Part|Pt)\\.?\\s*([0-9]+[A-Za-z]?)\\s*\\)?)?(?:\\s*\\(?\\s*(?:Sec|Section)\\.?\\s*([0-9]+)\\s*\\)?)?"
    "(?:\\s*[:/-]\\s*((?:19|20)[0-9]{2}))?(?:\\s*[,;]?\\s*(?:Amd|Amdt|Amendment)\\.?\\s*(?:No\\.?\\s*)?([0-9]+))?"
)


def _parsed(m: Column) -> Column:
    """The fields of one match, whose groups are read once. A dash after a plain number is its part; after an international one it stays."""
    groups = F.split(F.regexp_replace(m, f"(?s)^.*?{NUMBER}.*$", "\u0001".join(f"${i}" for i in range(1, 8))), "\u0001")

    def fields(g: Column, body: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i - 1))
        dash_part = (at(3) != "") & (body == "") & (at(4) == "")
        part = F.upper(F.when(dash_part, F.substring(at(3), 2, 9)).otherwise(at(4)))
        dash = F.when(dash_part, "").otherwise(at(3))
        bare = F.ltrim(at(2), F.lit("0"))
        number = F.when(bare == "", "0").otherwise(bare)
        tail = F.concat(F.when(part != "", F.concat(F.lit(" (Part "), part, F.lit(")"))).otherwise(""), F.when(at(5) != "", F.concat(F.lit(" (Sec "), at(5), F.lit(")"))).otherwise(""))
        letters = F.regexp_replace(body, "[^A-Z0-9]", "")
        ident = F.concat(
            F.lit("STD-"), F.when(body != "", F.concat(letters, F.lit("-"))).otherwise(""), bare, dash,
            F.when(part != "", F.concat(F.lit("-P"), part)).otherwise(""), F.when(at(5) != "", F.concat(F.lit("-S"), at(5))).otherwise(""),
        )
        return F.struct(
            strip(m).alias("display"),
            F.concat(F.lit("IS"), body, F.lit(" "), number, dash, tail).alias("canonical"),
            ident.alias("standard_id"),
            at(6).alias("year"),
            part.alias("part"),
            F.when(dash_part, "dash_form").when(at(4) != "", "explicit").otherwise("").alias("part_source"),
            at(5).alias("section"),
            at(7).alias("amendment"),
            (body != "").alias("international"),
        )

    return let(groups, lambda g: let(F.upper(F.regexp_replace(F.get(g, F.lit(0)), "[\\s]", "")), lambda body: fields(g, body)))


def parse_numbers(c: Column) -> Column:
    """All standard numbers of a text, as an array of structs."""
    found = F.regexp_extract_all(F.coalesce(squeeze(c), F.lit("")), F.lit(f"({NUMBER})"), F.lit(1))
    return F.transform(found, _parsed)


def distinct_numbers(c: Column) -> Column:
    """The first of each canonical number."""
    once = lambda found, names: F.filter(found, lambda x, i: F.array_position(names, x["canonical"]) == i + 1)
    return let(parse_numbers(c), lambda found: let(found["canonical"], lambda names: once(found, names)))


def first_number(c: Column) -> Column:
    """Struct (canonical, status): PARSED, PARSED_FIRST_OF_n, NO_REFERENCE or EMPTY."""

    def of(s: Column, found: Column) -> Column:
        n = F.size(found)
        status = F.when(~populated(s), "EMPTY").when(n == 0, "NO_REFERENCE").when(n == 1, "PARSED").otherwise(F.concat(F.lit("PARSED_FIRST_OF_"), n.cast("string")))
        return F.struct(F.coalesce(F.get(found["canonical"], F.lit(0)), F.lit("")).alias("canonical"), status.alias("status"))

    return let(squeeze(c), lambda s: let(parse_numbers(s), lambda found: of(s, found)))


# Cues inside packed cells.
DATE_CUE = "(?i)\\b(?:date[sd]?|dt\\.?|w\\.?e\\.?f\\.?|with effect from|published on|issued on|notified on)\\b[: ]*"
ORDER_NUMBER = "(?i)(?:S\\.?\\s*O\\.?|G\\.?\\s*S\\.?\\s*R\\.?|CG-DL-E|\\bNo\\.?)\\s*[-:]?\\s*[0-9][A-Za-z0-9_()./-]*"
TRAILING_DATE = "[,;(\\[ ]\\s*((?:[0-9]{1,2}[-/. ])?(?:[0-9]{1,2}|[A-Za-z]{3,9})[-/. ,]*[0-9]{4})\\s*[)\\]]?\\s*$"
BRACKETED_DATE = "\\(([0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{4}(?:\\s*[/&-]\\s*[0-9]{4})?)\\)"
ORGANISATION = "(?i)\\b(?:pvt|private|ltd|limited|inc|llc|llp|gmbh|co\\.?|corp(?:oration)?|company|industr(?:y|ies)|enterprises?|technolog(?:y|ies)|manufactur\\w*|group|holdings?|plc|srl|sas|pte)\\b\\.?"


def split_number_and_date(c: Column) -> Column:
    """Struct (number, note, date_text, method): an order number, its date, and what is left; nothing is invented."""
    trim = lambda x: F.regexp_replace(F.regexp_replace(x, "^[ ,;:\\-–(\\[/)\\]]+|[ ,;:\\-–(\\[/]+$", ""), "\\s{2,}", " ")

    def split(s: Column, method: Column) -> Column:
        date = F.when(method == "DATE_CUE", F.regexp_extract(s, f"{DATE_CUE}(.*)$", 1)).when(method == "PAREN_DATE", F.regexp_extract(s, BRACKETED_DATE, 1)).when(method == "TRAIL_DATE", F.regexp_extract(s, TRAILING_DATE, 1)).otherwise("")
        head = (
            F.when(method == "DATE_CUE", F.regexp_extract(s, f"^(.*?){DATE_CUE}", 1))
            .when(method == "PAREN_DATE", F.regexp_replace(s, BRACKETED_DATE, " "))
            .when(method == "TRAIL_DATE", F.regexp_replace(s, TRAILING_DATE, ""))
            .otherwise(s)
        )
        made = lambda h: F.struct(strip(F.regexp_extract(h, ORDER_NUMBER, 0)).alias("number"), trim(F.regexp_replace(h, ORDER_NUMBER, " ")).alias("note"), trim(date).alias("date_text"), method.alias("method"))
        return let(head, made)

    def of(s: Column) -> Column:
        method = F.when(~populated(s), "EMPTY").when(s.rlike(DATE_CUE), "DATE_CUE").when(s.rlike(BRACKETED_DATE), "PAREN_DATE").when(s.rlike(TRAILING_DATE), "TRAIL_DATE").otherwise("NO_CUE")
        return let(method, lambda m: split(s, m))

    return let(squeeze(c), of)


def split_number_and_product(c: Column) -> Column:
    """Struct (numbers, product, range_flag): the standards a cell names, and the product beside them."""
    s = squeeze(c)
    numbers = F.transform(distinct_numbers(c), lambda x: x["canonical"])
    rest = F.regexp_replace(F.regexp_replace(s, NUMBER, " "), "(?i)\\(\\s*(?:part|sec(?:tion)?)[^)]*\\)", " ")
    rest = F.trim(F.regexp_replace(rest, "\\s{2,}", " "))
    flag = F.when(rest.rlike("(?i)\\bto\\b") & (F.size(numbers) == 2), "RANGE_ENDPOINTS_ONLY").otherwise("")
    product = F.regexp_replace(rest, "(?i)^(?:(?:to|and|or|&|/|,|[0-9]{4})[\\s,/&-]*)+", "")
    product = F.regexp_replace(F.regexp_replace(product, "^[ ,;:/|&–—-]+|[ ,;:/|&–—-]+$", ""), "^\\(([^()]*)\\)$", "$1")
    return F.struct(numbers.alias("numbers"), F.when(populated(product), product).otherwise("").alias("product"), flag.alias("range_flag"))


ABBREVIATIONS = "(?<!\\bS\\.O)(?<!\\bG\\.S\\.R)(?<!\\bNo)(?<!\\bSec)(?<!\\bCl)(?<!\\bPt)(?<!\\betc)(?<!\\bi\\.e)(?<!\\be\\.g)(?<!\\bLtd)(?<!\\bPvt)(?<!\\bCo)(?<!\\bDept)(?<!\\bGovt)(?<!\\bVol)(?<!\\bAmdt)"
EXCLUSION = "(?i)\\b(?:exclusions?|excludes?|excluding|exempt(?:ed|ions?)?|not applicable to|shall not apply to|other than)\\b"
NEGATED = "(?i)\\b(?:no|none|nil|without|not any|zero)\\s+(?:\\w+\\s+){0,3}?(?:exclusions?|exemptions?)\\b"
AMENDMENT = "(?i)\\b(?:amend\\w*|corrigend(?:um|a)|supersed\\w+|revised by|substituted by)\\b"


def split_scope(c: Column) -> Column:
    """Struct (scope, exclusions, amendments): each sentence in exactly one; an abbreviation's point ends none."""

    def placed(x: Column) -> Column:
        place = F.when(x.rlike(AMENDMENT), "amendments").when(x.rlike(EXCLUSION) & ~x.rlike(NEGATED), "exclusions").otherwise("scope")
        return F.struct(F.trim(x).alias("text"), place.alias("place"))

    def of(s: Column) -> Column:
        marked = F.regexp_replace(s, f"(?:{ABBREVIATIONS}\\.|;)\\s+", "$0\u0001")
        sentences = F.when(populated(s), F.split(marked, "\u0001")).otherwise(F.array().cast("array<string>"))
        joined = lambda every, place: F.array_join(F.filter(every, lambda x: x["place"] == place)["text"], " ").alias(place)
        return let(F.transform(sentences, placed), lambda every: F.struct(*[joined(every, p) for p in ("scope", "exclusions", "amendments")]))

    return let(squeeze(c), of)


def split_name_and_address(c: Column) -> Column:
    """Struct (name, address, city, country, method): by labels, else at the comma after the last organisation word."""
    org = f"^(.*{ORGANISATION}[^,]*),(.*)$"

    def split(s: Column, method: Column) -> Column:
        label = lambda name: F.regexp_replace(F.trim(F.regexp_extract(s, f"(?i)\\|\\s*{name}\\s*:([^|]*)", 1)), "[ ,;]+$", "")
        before = F.regexp_replace(F.regexp_extract(s, "(?i)^(.*?)\\|\\s*(?:address|city|country|state|pin|postal code|zip)\\s*:", 1), "[ ,;|]+$", "")
        labelled, by_org = method == "LABELLED", method == "ORG_TOKEN_COMMA"
        shown = lambda name: let(label(name), lambda x: F.when(populated(x), x).otherwise(""))
        return F.struct(
            F.when(method == "EMPTY", "").when(labelled, before).when(by_org, F.trim(F.regexp_extract(s, org, 1))).otherwise(s).alias("name"),
            F.when(labelled, shown("address")).when(by_org, F.trim(F.regexp_extract(s, org, 2))).otherwise("").alias("address"),
            F.when(labelled, shown("city")).otherwise("").alias("city"),
            F.when(labelled, shown("country")).otherwise("").alias("country"),
            method.alias("method"),
        )

    def of(s: Column) -> Column:
        labelled = s.rlike("(?i)\\|\\s*(address|city|country|state|pin|postal code|zip)\\s*:")
        method = F.when(~populated(s), "EMPTY").when(labelled, "LABELLED").when(s.rlike(org), "ORG_TOKEN_COMMA").when(s.rlike(ORGANISATION), "ORG_TOKEN_NO_COMMA").otherwise("NO_LABEL_NO_ORG_TOKEN")
        return let(method, lambda m: split(s, m))

    return let(squeeze(c), of)


def norm_entity(kind: str, c: Column) -> Column:
    """The comparable forms of an entity cell: canonical numbers for STANDARD, the whole cell for DOCUMENT, else its parts."""
    if kind == "STANDARD":
        return F.array_sort(F.array_distinct(F.transform(parse_numbers(c), lambda x: x["canonical"])))
    s = squeeze(c)
    parts = F.array(s) if kind == "DOCUMENT" else F.split(s, "(?i)[;,|/\\n]+(?!IEC)|\\band\\b")
    forms = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.lower(p), "[^0-9a-zऀ-ॿ]+", " ")))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda p: (F.length(p) > 1) & populated(p))))


#: Transforms by name, so that a mapping can name them.
TRANSFORMS = {
    "squeeze": squeeze, "numbers": parse_numbers, "first_number": first_number, "number_and_date": split_number_and_date,
    "number_and_product": split_number_and_product, "scope": split_scope, "name_and_address": split_name_and_address,
}
