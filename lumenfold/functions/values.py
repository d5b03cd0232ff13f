"""Types, dates, addresses, order numbers and controlled vocabularies, as Spark column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import INTEGER, NUMBER, let, null_class, populated, squeeze, strip

# Patterns of dates and of lists in a cell.
DATE_LIKE = "^\\s*([0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{1,4})|^\\s*[0-9]{1,2}\\s+[A-Za-z]{3,9}\\s+[0-9]{4}\\s*$"
BOOLEANS = ["true", "false", "yes", "no", "y", "n", "0", "1"]
LIST_SEPARATOR = "[;,|]|\\band\\b"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def cell_kind(c: Column) -> Column:
    """int, float, date, bool, url or string; null for an empty cell."""
    s = strip(c.cast("string"))
    return (
        F.when(c.isNull() | (s == ""), F.lit(None).cast("string"))
        .when(s.rlike("(?i)https?://"), "url")
        .when(s.rlike(INTEGER), "int")
        .when(s.rlike(NUMBER), "float")
        .when(s.rlike(DATE_LIKE), "date")
        .when(F.lower(s).isin(BOOLEANS), "bool")
        .otherwise("string")
    )


def infer_type(kinds: Column) -> Column:
    """The type of a column from the sorted set of its cells' kinds."""
    without = lambda *names: F.size(F.array_except(kinds, F.array(*map(F.lit, names)))) == 0
    return (
        F.when(F.size(kinds) == 0, "empty")
        .when(F.size(kinds) == 1, F.element_at(kinds, 1))
        .when(without("int", "float"), "float")
        .when(without("int", "float", "bool"), "numeric_mixed")
        .when(without("date", "datetime"), "datetime")
        .when(without("url", "string"), "string")
        .otherwise(F.concat(F.lit("mixed("), F.array_join(kinds, "|"), F.lit(")")))
    )


def is_list(c: Column) -> Column:
    """Whether a value looks like a packed list."""
    s = c.cast("string")
    return (F.length(s) >= 3) & s.rlike(LIST_SEPARATOR) & s.rlike("[^\\s]\\s+[^\\s]")


def _month(name: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))), F.lit(0)).cast("int")


def _made(y: Column, m: Column, d: Column) -> Column:
    good = lambda x: x["y"].between(1900, 2100) & x["m"].between(1, 12) & x["d"].between(1, 31)
    numbers = F.struct(y.try_cast("int").alias("y"), m.try_cast("int").alias("m"), d.try_cast("int").alias("d"))
    return let(numbers, lambda x: F.when(good(x), F.format_string("%04d-%02d-%02d", x["y"], x["m"], x["d"])).otherwise(""))


# Forms of a date, in the order in which they are tried, and where their year, month and day stand.
DATE_FORMS = [
    ("iso", "^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", (1, 2, 3)),
    ("num", "^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})$", (3, 2, 1)),
    ("dmy", "^([0-9]{1,2})(?:st|nd|rd|th)?[ -]([A-Za-z]{3,9})\\.?,?[ -]([0-9]{4})$", (3, 2, 1)),
    ("mdy", "^([A-Za-z]{3,9})\\.?[ -]([0-9]{1,2})(?:st|nd|rd|th)?,?[ -]([0-9]{4})$", (3, 1, 2)),
    ("ym", "^([0-9]{4})[-/.]([0-9]{1,2})$", (1, 2)),
    ("my", "^([A-Za-z]{3,9})\\.?[ ,-]*([0-9]{4})$", (2, 1)),
]
YEAR = "^(?:19|20)[0-9]{2}$"


def ndate(c: Column) -> Column:
    """Struct (iso, precision, flag, raw). Partial dates keep their precision; day before month, flagged where both could be.

    The form is settled first, and its parts are read once.
    """

    def read(s: Column, form: Column) -> Column:
        """The year, month and day of a form, as text."""
        parts = F.when(F.lit(False), F.array().cast("array<string>"))
        for name, pattern, places in DATE_FORMS:
            parts = parts.when(form == name, F.split(F.regexp_replace(s, f"(?s){pattern}" + ("" if pattern.endswith("$") else ".*$"), "\u0001".join(f"${i}" for i in places)), "\u0001"))
        return parts.otherwise(F.array().cast("array<string>"))

    def formed(s: Column) -> Column:
        patterns = {name: pattern for name, pattern, _ in DATE_FORMS}
        named = {"mdy": _month(s) > 0, "my": _month(s) > 0, "ym": F.regexp_extract(s, patterns["ym"], 2).try_cast("int").between(1, 12)}
        form = F.when(F.lit(False), "")
        for name, pattern in patterns.items():
            form = form.when((s.rlike(pattern) & named[name]) if name in named else s.rlike(pattern), name)
        return form.when(s.rlike(YEAR), "y").otherwise("")

    def found(s: Column, form: Column, p: Column) -> Column:
        year, month, day = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
        long = F.when(F.length(year) == 2, F.concat(F.when(year.try_cast("int") < 50, "20").otherwise("19"), year)).otherwise(year)
        swap = (day.try_cast("int") <= 12) & (month.try_cast("int") > 12)
        text = lambda m: F.lpad(m.cast("string"), 2, "0")
        return (
            F.when(form == "iso", _made(year, month, day))
            .when(form == "num", _made(long, F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day)))
            .when(form == "dmy", _made(year, F.greatest(_month(month), F.lit(1)).cast("string"), day))
            .when(form == "mdy", _made(year, _month(month).cast("string"), day))
            .when(form == "ym", F.concat(year, F.lit("-"), text(month.try_cast("int"))))
            .when(form == "my", F.concat(year, F.lit("-"), text(_month(month))))
            .when(form == "y", s)
            .otherwise("")
        )

    def judged(raw: Column, live: Column, form: Column, p: Column, iso: Column) -> Column:
        whole = form.isin("iso", "num", "dmy", "mdy")
        ambiguous = (form == "num") & (F.get(p, F.lit(2)).try_cast("int") <= 12) & (F.get(p, F.lit(1)).try_cast("int") <= 12)
        return F.struct(
            F.when(live, iso).otherwise("").alias("iso"),
            F.when(~live, "").when(iso == "", "NONE").when(whole, "DAY").when(F.length(iso) == 7, "MONTH").otherwise("YEAR").alias("precision"),
            F.when(~live, "").when(iso == "", "UNPARSED_PRESERVED").when(ambiguous, "AMBIGUOUS_DMY").otherwise("").alias("flag"),
            raw.alias("raw"),
        )

    def of(raw: Column) -> Column:
        bare = F.trim(F.regexp_replace(raw, "[ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?(\\.[0-9]+)?$", ""))
        parsed = lambda s, form: let(read(s, form), lambda p: let(found(s, form, p), lambda iso: let(populated(raw), lambda live: judged(raw, live, form, p, iso))))
        return let(bare, lambda s: let(formed(s), lambda form: parsed(s, form)))

    return let(squeeze(c), of)


URL = "(?i)(?:https?://|ftp://)[^\\s<>\"'\\\\]+"
BARE_HOST = "(?i)^(?:www\\.[^\\s]+|[a-z0-9][a-z0-9.-]*\\.(?:gov\\.in|nic\\.in|org\\.in|co\\.in|com|org|net|in|gov)(?:/[^\\s]*)?)$"


def nurl(c: Column) -> Column:
    """Struct (url, label, cls): URL, URL_IN_TEXT, URL_SCHEME_ADDED, LABEL or EMPTY."""
    s = squeeze(c)
    hit = F.regexp_extract(s, f"({URL})", 1)
    url = F.regexp_replace(hit, "[.,;:)\\]}'\"]+$", "")
    rest = F.when(hit != "", squeeze(F.regexp_replace(s, F.concat(F.lit("\\Q"), hit, F.lit("\\E")), F.lit(" "))))

    def out(u: Column | str, label: Column | str, cls: Column | str) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(u).alias("url"), lit(label).alias("label"), lit(cls).alias("cls"))

    return (
        F.when(~populated(s), out("", "", "EMPTY"))
        .when(hit != "", out(url, rest, F.when(rest == "", "URL").otherwise("URL_IN_TEXT")))
        .when(s.rlike(BARE_HOST), out(F.concat(F.lit("https://"), F.regexp_replace(s, "^/+", "")), "", "URL_SCHEME_ADDED"))
        .otherwise(out("", s, "LABEL"))
    )


def norder(c: Column) -> Column:
    """An order number with its separators and abbreviations unified. ``No.`` needs a digit after it."""
    t = F.regexp_replace(squeeze(c), "(?i)\\bS\\.?\\s*O\\.?(?![a-z])\\s*", "S.O. ")
    t = F.regexp_replace(t, "(?i)\\bG\\.?\\s*S\\.?\\s*R\\.?(?![a-z])\\s*", "G.S.R. ")
    t = F.regexp_replace(t, "\\s*\\(\\s*[Ee]\\s*\\)", "(E)")
    t = F.regexp_replace(t, "(?i)\\bno\\b\\.?\\s*:?\\s*(?=[0-9])", "No. ")
    t = F.regexp_replace(t, "(?i)\\bdated?\\b", "dated")
    t = F.regexp_replace(F.regexp_replace(t, "\\s+", " "), "^[ .,;]+|[ .,;]+$", "")
    return F.when(populated(c), t).otherwise("")


def nnotification(c: Column) -> Column:
    return F.regexp_replace(norder(c), "\\b([0-9]{4})\\s*[-/]\\s*([0-9]{2})\\b", "$1-$2")


# The first pattern that matches gives the status.
STATUS_RULES = [
    ("de[- ]?recogni[sz]", "DERECOGNIZED"),
    ("with\\s?dr[aw]{2}n|withdrwan|withdral", "WITHDRAWN"),
    ("supersed|replaced\\s+by", "SUPERSEDED"),
    ("suspend", "SUSPENDED"),
    ("cancel|revok|terminat", "CANCELLED"),
    ("expir|lapsed", "EXPIRED"),
    ("draft|under\\s+(revision|development|preparation|formulation)|\\bwip\\b", "DRAFT"),
    ("propos|upcoming|forthcoming|to\\s+be\\s+notified", "PROPOSED"),
    ("recogni[sz]ed|accredit|empanel", "RECOGNIZED"),
    ("notified|gazett", "NOTIFIED"),
    ("\\bactive\\b|in\\s?force|\\bcurrent\\b|\\bvalid\\b|operational|existing|published|reaffirm|\\blive\\b|\\byes\\b", "ACTIVE"),
]


def first_match(s: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    return reduce(lambda w, r: w.when(s.rlike(r[0]), r[1]), rules, F.when(F.lit(False), "")).otherwise(otherwise)


def nstatus(c: Column, rules: list[tuple[str, str]] = STATUS_RULES) -> Column:
    """Struct (status, original); populated text without a rule is OTHER, everything else UNKNOWN."""
    s = squeeze(c)
    return F.struct(F.when(populated(c), first_match(F.lower(s), rules, "OTHER")).otherwise("UNKNOWN").alias("status"), s.alias("original"))


def nmandatory(c: Column) -> Column:
    s = F.lower(squeeze(c))
    must, may = s.rlike("mandator|compulsor|obligator"), s.rlike("voluntar|optional")
    return F.when(~populated(c), "UNKNOWN").when(must & may, "BOTH").when(must, "MANDATORY").when(may, "VOLUNTARY").otherwise("OTHER")


def nname(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(squeeze(c), "\\s*/\\s*", "/"), "^[ .;,-]+|[ .;,-]+$", "")
    return F.when(populated(c), F.regexp_replace(s, "\\s+", " ")).otherwise("")


def nlicence(c: Column) -> Column:
    """Struct (licence_no, licence_key, cls): CML with its digits, else the first run of four digits, else LABEL."""
    s = squeeze(c)
    marked = F.regexp_replace(F.regexp_extract(s, "(?i)\\b(?:CM\\s*/?\\s*L|CML)\\s*[-–:/]?\\s*([0-9][0-9\\s./-]*[0-9]|[0-9])", 1), "[^0-9]", "")
    run = F.regexp_extract(s, "[0-9]{4,}", 0)
    key = F.when(marked != "", marked).otherwise(run)
    live = populated(c)
    return F.struct(
        F.when(~live, "").when(key != "", F.concat(F.lit("CM/L-"), key)).otherwise(s).alias("licence_no"),
        F.when(live, key).otherwise("").alias("licence_key"),
        F.when(~live, "EMPTY").when(marked != "", "CML").when(run != "", "DIGITS_ONLY").otherwise("LABEL").alias("cls"),
    )


# Words that show a sentence rather than a list.
PROSE = "(?i)\\b(shall|must|should|may be|will be|is to be|are to be|means|refers to|as defined|in accordance|thereof|hereby)\\b"
LEAD = (
    "(?i)^(and|or|but|which|that|who|whose|where|when|while|including|such as|as per|with|without|for|to|in|of|by|on|at|from|under|per|"
    "using|after|before|during|so|not|all|any|each|either|both|based|subject|provided|except|unless|however|therefore|thus|also|if|then|"
    "shall|must|may|etc|e\\.g|i\\.e)\\b"
)
TRAIL = "(?i)\\b(and|or|of|for|the|a|an|with|in|to|by|as|shall|is|are)\\s*$"


def _split_outside(s: Column, separators: str) -> Column:
    """Split at separators that stand outside brackets, by a fold over the characters where any bracket opens."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("part"), F.lit(0).alias("depth"))

    def step(acc: Column, ch: Column) -> Column:
        depth = F.when(ch.isin("(", "[", "{"), acc["depth"] + 1).when(ch.isin(")", "]", "}"), F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        return let(
            F.struct(depth.alias("depth"), ((depth == 0) & ch.isin(*separators)).alias("cut")),
            lambda x: F.struct(
                F.when(x["cut"], F.concat(acc["done"], F.array(acc["part"]))).otherwise(acc["done"]).alias("done"),
                F.when(x["cut"], "").otherwise(F.concat(acc["part"], ch)).alias("part"),
                x["depth"].alias("depth"),
            ),
        )

    folded = F.aggregate(F.split(s, ""), zero, step, lambda acc: F.concat(acc["done"], F.array(acc["part"])))
    return F.transform(F.when(s.rlike("[(\\[{]"), folded).otherwise(F.split(s, f"[{separators}]")), squeeze)


def split_list(c: Column, floor: int = 2) -> Column:
    """The members of a list cell. Brackets protect; a sentence isn't split at commas; repeats differ in more than case."""

    def members(s: Column, by_comma: Column) -> Column:
        longest = F.array_max(F.transform(by_comma, F.length))
        wordiest = F.array_max(F.transform(by_comma, lambda p: F.size(F.split(p, " "))))
        n = F.size(by_comma)
        led = F.exists(F.slice(by_comma, 2, F.greatest(n - 1, F.lit(1))), lambda p: p.rlike(LEAD))
        trailed = F.exists(F.slice(by_comma, 1, F.greatest(n - 1, F.lit(0))), lambda p: p.rlike(TRAIL))
        prose = s.rlike(PROSE) | (longest > 90) | (wordiest > 12) | led | trailed
        # a text without any separator is its own part
        by_rest = F.when(s.rlike("[;|]"), _split_outside(s, ";|\n")).otherwise(F.array(s))
        return F.filter(F.when(prose, by_rest).otherwise(by_comma), populated)

    def different(parts: Column) -> Column:
        return let(F.transform(parts, F.lower), lambda lows: F.filter(parts, lambda p, i: F.array_position(lows, F.lower(p)) == i + 1))

    def of(s: Column) -> Column:
        by_comma = F.when(s.rlike("[;|,]"), _split_outside(s, ";|\n,")).otherwise(F.array(s))
        found = let(by_comma, lambda a: let(members(s, a), lambda parts: F.when(F.size(parts) < floor, F.slice(parts, 1, 1)).otherwise(different(parts))))
        return F.when(~populated(s), F.array().cast("array<string>")).otherwise(found)

    return let(squeeze(c), of)
