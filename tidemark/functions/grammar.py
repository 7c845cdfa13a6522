"""Quantities, pay, dates and requirement cues from quoted spans, as DataFrame expressions.

A grammar that cannot read a span gives null: it never guesses. Patterns and word lists below are fixed values that decide which spans are read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(\d+(?:\.\d+)?)"
RANGE = NUMBER + r"\s*(?:-|–|—|to)\s*" + NUMBER
PLUS = NUMBER + r"\s*\+"
COMPARISONS = {
    "gte": r"at\s+least|a\s+minimum\s+of|minimum\s+of|minimum|no\s+less\s+than",
    "gt": r"more\s+than|over|greater\s+than",
    "lte": r"up\s+to|at\s+most|no\s+more\s+than|maximum\s+of|maximum",
    "lt": r"less\s+than|fewer\s+than|under",
}
GLUE = r"[\s+()\[\]\-‐‑‒–—−]"
#: groups: years, months, percent, times per, units that the record cannot spell
UNIT = r"(?<![A-Za-z])(?:(years?|yrs?|yoe)|(months?|mos?)|(%|percent)|times?\s+per\s+(week|month|day)|(hours?|hrs?|days?|weeks?|wks?))(?![A-Za-z])"
CARRIED = r"(?iU)\d(?:" + GLUE + r"|or\s+more|plus)*" + UNIT
ANCHOR = r"(?iU)^" + GLUE + "*" + UNIT
PLUS_WORDS = r"(?iU)^(?:(\d+(?:\.\d+)?)\s*)?\+$|^or\s+(?:more|above|greater)$"
PREFERRED = r"(?iU)\b(?:prefer(?:red|ably)?|ideally|plus|nice[\s-]to[\s-]have|bonus|desired|desirable|optional|advantage(?:ous)?)\b"
REQUIRED = r"(?iU)\b(?:must|require[sd]?|requirements?|minimum|basic\s+qualifications?|mandatory|essential|at\s+least|need(?:ed)?)\b"
MODAL_TERMS = ("must have", "must", "required", "requirement", "minimum", "at least", "preferred", "nice to have", "bonus", "plus", "ideally", "desired")
SYMBOLS = {"£": "GBP", "€": "EUR"}
CODES = "USD|CAD|AUD|NZD|SGD|HKD|EUR|GBP|JPY|CNY|CHF|SEK|INR|TWD|KRW"
CODES_WIDE = CODES + "|MXN|COP|BRL|CLP|ARS|PEN|PLN|CZK|HUF|RON|DKK|NOK|ILS|AED|SAR|ZAR|TRY|PHP|MYR|IDR|THB|VND"
DOLLARS = {"C": "CAD", "CA": "CAD", "A": "AUD", "AU": "AUD", "NZ": "NZD", "S": "SGD", "HK": "HKD", "US": "USD", "R": "BRL", "MX": "MXN"}
AMOUNT = r"([$£€¥]?)\s*(\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d{1,3}(?:\.\d{3})+|\d+(?:\.\d{1,2})?)\s*([kK])?"
PERIODS = {
    "hour": r"/\s*(?:hr|hour)|per\s+hour|hourly",
    "year": r"/\s*(?:yr|year)|per\s+(?:year|annum)|annually|annual|yearly",
    "month": r"per\s+month|monthly",
    "week": r"per\s+week|weekly",
    "day": r"per\s+day|daily",
}
PERIODS_WIDE = {
    "hour": r"/\s*(?:hr|hour|heure|hora|h)\b|per\s+hour|an\s+hour|hourly|par\s+heure|de\s+l'heure|horaire|por\s+hora|pro\s+stunde|stündlich|stundenlohn",
    "year": r"/\s*(?:yr|year)\b|per\s+(?:year|annum)|a\s+year|annually|annual|yearly|par\s+an(?:née)?|annuel(?:le)?|anual(?:es)?|por\s+año|jährlich|pro\s+jahr",
    "month": r"/\s*(?:mo|month|mois|mes)\b|per\s+month|a\s+month|monthly|mensual(?:es)?|mensuel(?:le)?|par\s+mois|por\s+mes|monatlich|pro\s+monat",
    "week": r"/\s*(?:wk|week)\b|per\s+week|weekly|semanal|hebdomadaire|wöchentlich",
    "day": r"/\s*day\b|per\s+day|daily|por\s+día|par\s+jour",
}
OTHER_DOLLARS = r"\b(?:CAD|AUD|NZD|SGD|HKD|MXN|COP|CLP|ARS|TWD|BRL)\b|(?i)\b(?:Canada|Canadian|Australia|Australian|New\s+Zealand|Singapore|Hong\s+Kong|Mexico|México|Colombia|Chile|Argentina|Taiwan|Brazil|Brasil)\b"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
LABEL_MOST = 60


def _let(parts: dict[str, Column], body) -> Column:
    """body over a struct of the parts: each part is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in parts.items()])), body), F.lit(0))


def _group(text: Column, pattern: str, k: int) -> Column:
    got = F.regexp_extract(text, pattern, k)
    return F.when(got != "", got)


def comparison(cited: Column, value: Column, plus_is_floor: bool = False) -> Column:
    """gte, gt, lte or lt when one phrase is all of the cited text; "?" for other text; null where nothing is cited."""
    text = F.trim(cited)
    found = F.lit("?")
    for op, words in reversed(COMPARISONS.items()):
        found = F.when(text.rlike(f"(?iU)^(?:{words})$"), op).otherwise(found)
    if plus_is_floor:
        number = _group(text, PLUS_WORDS, 1)
        own = F.exists(F.regexp_extract_all(value, F.lit(r"(?<![\d.])(\d+(?:\.\d+)?)\s*\+"), F.lit(1)), lambda x: x == number)
        found = F.when(text.rlike(PLUS_WORDS), F.when(number.isNull() | own, "gte").otherwise("?")).otherwise(found)
    return F.when(cited.isNotNull(), found)


def quantity(value: Column, cited: Column | None = None, unit: Column | None = None, plus_is_floor: bool = False) -> Column:
    """struct(dimension, comparison, min_value, max_value, inclusive_min, inclusive_max, unit), or null.

    The unit is the word that the number carries, else the first word of the cited unit; years are months times twelve."""
    cited = F.lit(None).cast("string") if cited is None else cited
    unit = F.lit(None).cast("string") if unit is None else unit
    given = {"value": value, "op": comparison(cited, value, plus_is_floor), "letters": value.rlike("[A-Za-z]"), "carried": value.rlike(CARRIED), "unit": F.trim(unit)}
    return _let(given, lambda p: _quantity_of(p, plus_is_floor))


def _quantity_of(p: Column, plus_is_floor: bool) -> Column:
    anchored = ~p["carried"] & ~p["letters"] & (F.coalesce(p["unit"], F.lit("")) != "")
    part = lambda k: F.when(p["carried"], _group(p["value"], CARRIED, k)).when(anchored, _group(p["unit"], ANCHOR, k))
    words = {f"w{k}": part(k) for k in range(1, 6)}
    numbers = {"lo": _group(p["value"], "(?U)" + RANGE, 1), "hi": _group(p["value"], "(?U)" + RANGE, 2), "plus": _group(p["value"], "(?U)" + PLUS, 1), "one": _group(p["value"], "(?U)" + NUMBER, 1)}
    rest = {"value": p["value"], "op": p["op"], "anchored": anchored, "letters": p["letters"]}
    return _let(words | numbers | rest, lambda x: _quantity_built(x, plus_is_floor))


def _quantity_built(p: Column, plus_is_floor: bool) -> Column:
    value, op = p["value"], p["op"]
    years, months, percent, per, other = (p[f"w{k}"] for k in range(1, 6))
    known = F.coalesce(years, months, percent, per).isNotNull()
    dimension = F.when(years.isNotNull() | months.isNotNull(), "duration").when(percent.isNotNull(), "percentage").when(per.isNotNull(), "frequency").otherwise("count")
    spelled = F.when(years.isNotNull() | months.isNotNull(), "month").when(percent.isNotNull(), "percent").when(per.isNotNull(), F.concat(F.lit("per_"), F.lower(per)))
    scale = F.when(years.isNotNull(), 12.0).otherwise(1.0)
    unreadable = (op == "?") | other.isNotNull() | (~known & (p["anchored"] | p["letters"]))

    def q(c, lo, hi, inc_lo, inc_hi) -> Column:
        none = F.lit(None)
        return F.struct(
            dimension.alias("dimension"), (F.lit(c) if isinstance(c, str) else c).alias("comparison"), (none if lo is None else lo).cast("double").alias("min_value"), (none if hi is None else hi).cast("double").alias("max_value"),
            (none if inc_lo is None else inc_lo).cast("boolean").alias("inclusive_min"), (none if inc_hi is None else inc_hi).cast("boolean").alias("inclusive_max"), spelled.alias("unit"),
        )

    wide = "(?U)" + RANGE
    lo, hi, plus, one = (p[k].try_cast("double") * scale for k in ("lo", "hi", "plus", "one"))
    floor_ok = op.isNull() | (op == "gte") if plus_is_floor else op.isNull()
    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(F.coalesce(unreadable, no) | value.isNull(), None)
        .when(value.rlike(wide), F.when(op.isNull() & (lo <= hi), q("range", lo, hi, yes, yes)))
        .when(value.rlike("(?U)" + PLUS), F.when(floor_ok, q("gte", plus, None, yes, None)))
        .when(F.regexp_count(value, F.lit("(?U)" + NUMBER)) != 1, None)
        .when(op.isNull(), q("unstated", one, one, None, None))
        .when(op.isin("gte", "gt"), q(op, one, None, op == "gte", None))
        .otherwise(q(op, None, one, None, op == "lte"))
    )


def requirement(modal: Column, heading: Column, kind: Column | None = None) -> Column:
    """required, preferred or null: of the modal quote, else of the heading; a cue that names both decides nothing."""
    def cue(text: Column) -> Column:
        a, b = text.rlike(PREFERRED), text.rlike(REQUIRED)
        return F.when(a & b, None).when(a, "preferred").when(b, "required")

    found = F.coalesce(cue(modal), cue(heading))
    return found if kind is None else F.coalesce(found, F.when(kind == "qualification", "preferred"))


def modal_label(quote: Column) -> Column:
    """The first modal term in a quote (the longest at one place), else the quote itself, trimmed."""
    lowered = F.lower(quote)
    at = F.filter(F.array(*[F.struct(F.locate(t, lowered).alias("at"), F.lit(-len(t)).alias("size"), F.lit(t).alias("term")) for t in MODAL_TERMS]), lambda x: x["at"] > 0)
    return F.coalesce(F.array_min(at)["term"], F.trim(quote))


def period(text: Column, words: dict[str, str] = PERIODS) -> Column:
    """The unit of the first period word."""
    names = list(words)
    pattern = "(?iU)" + "|".join(f"({w})" for w in words.values())
    found = F.lit(None).cast("string")
    for k, name in reversed(list(enumerate(names, 1))):
        found = F.when(F.regexp_extract(text, pattern, k) != "", name).otherwise(found)
    return F.when(text.rlike(pattern), found)


def _periods_named(text: Column) -> Column:
    """All different period units in a text."""
    return F.filter(F.array(*[F.when(text.rlike(f"(?iU)(?:{w})"), name) for name, w in PERIODS_WIDE.items()]), lambda x: x.isNotNull())


def _amount(digits: Column, k: Column) -> Column:
    """Digits as a plain decimal string: separators off, thousands multiplied out; null where k follows a decimal point."""
    plain = F.replace(F.when(digits.rlike(r"^\d{1,3}(?:\.\d{3})+$"), F.replace(digits, F.lit("."))).otherwise(digits), F.lit(","))
    return F.when(F.coalesce(k, F.lit("")) == "", plain).when(plain.contains("."), None).otherwise((plain.try_cast("decimal(30,0)") * 1000).cast("decimal(33,0)").cast("string"))


def money(value: Column, cited: Column, currency: Column, period_text: Column, label: Column | None = None, dollar: Column | None = None) -> Column:
    """struct(comparison, min_amount, max_amount, currency, period), or null; amounts stay decimal strings.

    With label (the amount's own line, after a short line above it) and dollar (what a bare $ means in this document), the wider
    grammar applies: codes and prefixed dollars inside the amount, trailing symbols, ranges cited in two parts."""
    text = F.trim(value)
    wide = label is not None
    joins = r"--?|–|—|to|à|and|bis" if wide else r"--?|–|—|to"
    range_word = cited.isNotNull() & F.trim(cited).rlike(r"(?iU)^(?:between|from|range|-|–|—|to|à|and)$") if wide else F.lit(False)
    op = comparison(F.when(~range_word, cited), value)
    code = F.upper(F.coalesce(*[_group(t, rf"(?U){flag}\b({codes})\b", 1) for t in (currency, text) for flag, codes in ((("", CODES_WIDE), ("(?i)", CODES)) if wide else (("(?i)", CODES),))]))
    if wide:
        prefixed = r"\b(CA|C|AU|A|NZ|S|HK|US|R|MX)\$"
        names = F.create_map(*[F.lit(x) for kv in DOLLARS.items() for x in kv])
        symbol = lambda t: F.when(t.contains("£"), "GBP").when(t.contains("€"), "EUR")
        code = F.coalesce(code, *[f(t) for t in (currency, text) for f in (lambda t: F.try_element_at(names, _group(t, prefixed, 1)), symbol)])
        text = F.regexp_replace(text, prefixed, F.lit("\\$"))
        text = F.trim(F.regexp_replace(F.regexp_replace(text, rf"\b(?:{CODES_WIDE})\b|(?i)\b(?:{CODES})\b", " "), r"(?U)\s+", " "))
        text = F.regexp_replace(text, r"(\d(?:[\d.,]*\d)?)\s*([$£€¥])(?!\s*\d)", "$2$1")
        text = F.when(range_word & text.rlike(rf"^{AMOUNT}\s+{AMOUNT}$"), F.regexp_replace(text, rf"^{AMOUNT}\s+{AMOUNT}$", "$1$2$3 - $4$5$6")).otherwise(text)
    lasting = period(period_text)
    if wide:
        codes = F.array_distinct(F.regexp_extract_all(label, F.lit(rf"\b({CODES_WIDE})\b"), F.lit(1)))
        dollar = F.when(F.size(codes) == 1, F.get(codes, F.lit(0))).otherwise(dollar)
        told = _periods_named(label)
        lasting = F.coalesce(period(period_text, PERIODS_WIDE), F.when(F.size(told) == 1, F.get(told, F.lit(0))).when((F.size(told) == 0) & label.rlike(r"(?iU)\b(?:salary|salario|salaire|gehalt)\b"), "year"))
    none = F.lit(None).cast("string")
    given = {"value": value, "text": text, "op": op, "code": code, "range_word": range_word, "dollar": none if dollar is None else dollar, "period": lasting}
    pair, single = rf"(?U){'(?i)' if wide else ''}^{AMOUNT}\s*(?:{joins})\s*{AMOUNT}$", rf"(?U)^{AMOUNT}$"
    parts = lambda p: {f"p{k}": _group(p["text"], pair, k) for k in range(1, 7)} | {f"o{k}": _group(p["text"], single, k) for k in range(1, 4)} | {k: p[k] for k in given}
    return _let(given, lambda p: _let(parts(p), lambda x: _money_built(x, pair, single)))


def _money_built(p: Column, pair: str, single: str) -> Column:
    value, text, op, range_word = p["value"], p["text"], p["op"], p["range_word"]
    s1, d1, k1, s2, d2, k2 = (p[f"p{k}"] for k in range(1, 7))
    lo, hi = _amount(d1, k1), _amount(d2, k2)
    both_k = k2.isNotNull() & k1.isNull() & (lo.try_cast("double") < 1000)
    lo = F.when(both_k, F.floor(lo.try_cast("double") * 1000).cast("long").cast("string")).otherwise(lo)
    sign, digits, k = (p[f"o{i}"] for i in range(1, 4))
    one = _amount(digits, k)
    sign = F.when(text.rlike(pair), F.coalesce(s1, s2)).otherwise(sign)
    named = F.coalesce(p["code"], F.when(sign == "£", "GBP").when(sign == "€", "EUR").when(sign == "$", p["dollar"]))
    lasting = p["period"]

    def m(c, a, b) -> Column:
        none = F.lit(None).cast("string")
        return F.struct((F.lit(c) if isinstance(c, str) else c).alias("comparison"), (none if a is None else a).alias("min_amount"), (none if b is None else b).alias("max_amount"), named.alias("currency"), lasting.alias("period"))

    bad_range = (s1.isNotNull() & s2.isNotNull() & (s1 != s2)) | lo.isNull() | hi.isNull() | (lo.try_cast("double") > hi.try_cast("double")) | op.isNotNull()
    return (
        F.when(F.coalesce(op == "?", F.lit(False)) | value.isNull(), None)
        .when(text.rlike(pair), F.when(~F.coalesce(bad_range, F.lit(False)), m("range", lo, hi)))
        .when(~text.rlike(single) | range_word | one.isNull(), None)
        .when(op.isNull(), m("unstated", one, one)).when(op.isin("gte", "gt"), m(op, one, None)).otherwise(m(op, None, one))
    )


def date(value: Column) -> Column:
    """struct(date, candidates): the first date with a month's name, else a numeric one; both readings where they differ."""
    numbers = F.create_map(*[F.lit(x) for i, n in enumerate(MONTHS, 1) for k in {n, n[:3]} for x in (k, i)])
    matches = F.regexp_extract_all(value, F.lit(r"(?U)[A-Za-z]+\.?\s+\d{1,2},\s*\d{4}"), F.lit(0))
    parts = F.transform(matches, lambda t: F.struct(F.try_element_at(numbers, F.lower(F.regexp_extract(t, "^([A-Za-z]+)", 1))).alias("m"), F.regexp_extract(t, r"(\d{1,2}),", 1).alias("d"), F.regexp_extract(t, r"(\d{4})$", 1).alias("y")))
    named = F.get(F.filter(parts, lambda p: p["m"].isNotNull()), F.lit(0))
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m.cast("string"), d), "yyyy-M-d")
    numeric = r"(?U)\b(\d{1,2})/(\d{1,2})/(\d{2}(?:\d{2})?)\b"
    a, b, y = (_group(value, numeric, k) for k in (1, 2, 3))
    y = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    readings = F.array_sort(F.array_distinct(F.filter(F.array(day(y, a, b), day(y, b, a)), lambda x: x.isNotNull())))
    none = F.lit(None)
    only = lambda d: F.struct(d.alias("date"), none.cast("array<date>").alias("candidates"))
    from_named = day(named["y"], named["m"], named["d"])
    return (
        F.when(named.isNotNull(), F.when(from_named.isNotNull(), only(from_named)))
        .when(F.size(readings) == 1, only(F.get(readings, F.lit(0))))
        .when(F.size(readings) == 2, F.struct(none.cast("date").alias("date"), readings.alias("candidates")))
    )


def other_dollar(text: Column) -> Column:
    """Does a text name a dollar that is not the United States'?"""
    return text.rlike(OTHER_DOLLARS) | F.replace(text, F.lit("US$")).rlike(r"\b(?:CA|C|AU|A|NZ|S|HK|US|R|MX)\$")


def experience_months(text: Column) -> Column:
    """struct(comparison, min_months, max_months): a range, a floor, or exactly one number of years."""
    years = r"\s*(?:years?|yrs?)"
    wide, floor = rf"(?iU)(\d+)\s*(?:-|–|—|to)\s*(\d+)\+?{years}", rf"(?iU)(?:at\s+least|minimum(?:\s+of)?|(?<!no\s)(?<!not\s)(?:more\s+than|over))\s+(\d+){years}|(\d+)\s*(?:\+|or\s+more){years}|(\d+){years}\s+or\s+more"
    exact = rf"(?iU)(\d+){years}"
    n = lambda p, k: _group(text, p, k).try_cast("int") * 12
    q = lambda c, lo, hi: F.struct(F.lit(c).alias("comparison"), lo.cast("int").alias("min_months"), hi.cast("int").alias("max_months"))
    least = F.coalesce(n(floor, 1), n(floor, 2), n(floor, 3))
    return (
        F.when(text.rlike(wide), F.when(n(wide, 1) <= n(wide, 2), q("range", n(wide, 1), n(wide, 2))))
        .when(text.rlike(floor), q("gte", least, F.lit(None)))
        .when(F.regexp_count(text, F.lit(exact)) == 1, q("exact", n(exact, 1), n(exact, 1)))
    )


def deadline(text: Column) -> Column:
    """The one date that a text names, month first; null if it names none or several, or one that no calendar has. Two-digit years are of this century."""
    numbers = F.create_map(*[F.lit(x) for i, n in enumerate(MONTHS, 1) for k in {n, n[:3]} for x in (k, i)])
    worded = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"(?U)[A-Za-z]+\.?\s+\d{1,2},\s*\d{4}"), F.lit(0)),
            lambda t: F.struct(F.try_element_at(numbers, F.lower(F.regexp_extract(t, "^([A-Za-z]+)", 1))).alias("m"), F.regexp_extract(t, r"(?U)(\d{1,2}),\s*(\d{4})$", 1).alias("d"), F.regexp_extract(t, r"(?U)(\d{4})$", 1).alias("y")),
        ),
        lambda p: p["m"].isNotNull(),
    )
    numeric = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\b\d{1,2}/\d{1,2}/\d{2}(?:\d{2})?\b"), F.lit(0)), lambda t: F.split(t, "/"))
    year = lambda y: F.when(y.cast("int") < 100, y.cast("int") + 2000).otherwise(y.cast("int"))
    read = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd")
    dates = F.concat(F.transform(worded, lambda p: read(p["y"], p["m"], p["d"])), F.transform(numeric, lambda p: read(year(p[2]), p[0], p[1])))
    return F.when(F.size(dates) == 1, F.get(dates, F.lit(0)))


#: What a line of pay is read by. Signs name one currency each, but kr; a bare amount (no sign or code on its left) may not be grouped by spaces.
PAY_SIGNS = {"£": "GBP", "€": "EUR", "ca$": "CAD", "a$": "AUD", "nz$": "NZD", "s$": "SGD", "hk$": "HKD", "r$": "BRL", "zł": "PLN", "kč": "CZK", "rm": "MYR"}
PAY_CODES = "USD|CAD|AUD|NZD|SGD|HKD|EUR|GBP|JPY|CNY|CHF|SEK|INR|TWD|KRW|DKK|NOK|PLN|CZK|MYR|BRL|MXN|ILS"
PAY_SIGN = r"(?:(?<![A-Za-z])(?:CA\$|NZ\$|HK\$|A\$|S\$|R\$|zł|Kč|RM|kr)|[$£€¥])"
PAY_CODE = rf"({PAY_CODES})"
PAY_AMOUNT = r"(\d{1,3}(?:,\d{3})+|\d{1,3}(?: \d{3})+|\d{1,3}(?:\.\d{3})+|\d+)(?:[.,]\d{1,2})?\s*(k)?"
PAY_BARE = r"(?<![\d.,])(\d{1,3}(?:,\d{3})+|\d{1,3}(?:\.\d{3})+|\d{4,}|\d{1,3}(?=\s?[kK]\b)|(?<!\d )\d{3}|\d{1,2})(?:\.\d{1,2})?(?! ?\d)\s*(k)?"
PAY_THOUSANDS = r"(\d{1,3}(?:,\d{3})+)(?:[.,]\d{1,2})?\s*(k)?"
PAY_UNIT = r"(?:\s*/\s*(?:hr|hour|yr|year|mo|month))?"
PAY_TO = r"(?:--?|–|—|−|to)"
PAY_HOURLY = r"(?iU)(?:/\s*(?:hr|hour)|per\s+hour)\b"
PAY_YEARLY = r"(?iU)(?:/\s*(?:yr|year)|per\s+(?:year|annum)|annually|annual)\b"
PAY_CEILING = r"(?iU)\b(?:up\s+to|at\s+most|maximum\s+of|no\s+more\s+than|not\s+to\s+exceed)\b"
PAY_FLOOR = r"(?iU)\b(?:starting\s+(?:at|from)|from|at\s+least|minimum\s+of)\b"
RANGE_BEFORE = r"(?iU)\d[\s.,]*(?:--?|–|—|−|\bto)\s*$"
RANGE_AFTER = r"(?iU)^\s*(?:--?|–|—|−|to\b)\s*[$£€¥]?\s*\d"


def pay_amount(digits: Column, k: Column) -> Column:
    """Whole units: thousands by comma, space or point; k multiplies. Null where it has over 30 digits."""
    plain = F.when(digits.rlike(r"^\d{1,3}(?:\.\d{3})+$"), F.replace(digits, F.lit("."))).otherwise(digits)
    whole = F.translate(plain, ", ", "").try_cast("decimal(30,0)")
    return F.when(k.isNotNull(), whole * 1000).otherwise(whole).cast("decimal(38,0)")


def compensation(text: Column) -> Column:
    """struct(min, max, currency, period): the pay that a line names as a range, or as exactly one amount with a sign or a code; null where it is ambiguous.

    Ranges are tried first: by signs, by codes before and by codes after the amounts, and bare ones before the word OTE with a period. One amount is both
    bounds, unless a word makes it a ceiling or a floor; one that touches a range's dash is none. A null text gives null."""
    signed = rf"({PAY_SIGN})\s*{PAY_AMOUNT}{PAY_UNIT}(?:\s*[A-Z]{{3}})?\s*{PAY_TO}\s*({PAY_SIGN}?)\s*{PAY_AMOUNT}{PAY_UNIT}"
    led = rf"{PAY_CODE}\s*{PAY_AMOUNT}{PAY_UNIT}\s*{PAY_TO}\s*{PAY_CODE}\s*{PAY_AMOUNT}{PAY_UNIT}"
    trailed = rf"{PAY_BARE}{PAY_UNIT}\s*{PAY_CODE}?\s*{PAY_TO}\s*{PAY_BARE}{PAY_UNIT}\s*{PAY_CODE}\b"
    bare = rf"{PAY_THOUSANDS}{PAY_UNIT}\s*{PAY_TO}\s*{PAY_THOUSANDS}{PAY_UNIT}\s+OTE\b"
    token = rf"(?iU){PAY_SIGN}\s*{PAY_AMOUNT}{PAY_UNIT}|{PAY_AMOUNT}{PAY_UNIT}\s*{PAY_CODE}\b|{PAY_CODE}\s*{PAY_AMOUNT}{PAY_UNIT}"
    one_signed, one_led, one_trailed = rf"({PAY_SIGN})\s*{PAY_AMOUNT}{PAY_UNIT}", rf"{PAY_CODE}\s*{PAY_AMOUNT}{PAY_UNIT}", rf"{PAY_BARE}{PAY_UNIT}\s*{PAY_CODE}\b"
    has = lambda pattern: text.rlike(f"(?iU){pattern}")
    lasting = F.when(text.rlike(PAY_HOURLY), "hour").when(text.rlike(PAY_YEARLY), "year")

    def shape(kind: str, pattern: str, *groups: int) -> Column:
        """The groups in order: amount and k of the lower, of the upper bound, the two signs or codes, what is before and behind; by one match."""
        parts = F.split(F.regexp_replace(text, f"(?isU)^(.*?)(?:{pattern})(.*)$", "\u0001".join(f"${g + 1}" if g >= 0 else "" for g in groups)), "\u0001", -1)
        return F.struct(F.lit(kind).alias("kind"), parts.alias("parts"))

    found = (
        F.when(~text.rlike(r"(?U)\d"), None)
        .when(has(signed), shape("signed", signed, 2, 3, 5, 6, 1, 4)).when(has(led), shape("coded", led, 2, 3, 5, 6, 1, 4)).when(has(trailed), shape("coded", trailed, 1, 2, 4, 5, 3, 6))
        .when(has(bare) & lasting.isNotNull(), shape("bare", bare, 1, 2, 3, 4, -1, -1)).when(F.regexp_count(text, F.lit(token)) != 1, None)
        .when(has(one_signed), shape("one signed", one_signed, 2, 3, -1, -1, 1, -1, 0, 4)).when(has(one_led), shape("one coded", one_led, 2, 3, -1, -1, 1, -1, 0, 4)).when(has(one_trailed), shape("one coded", one_trailed, 1, 2, -1, -1, 3, -1, 0, 4))
    )

    def read(p: Column) -> dict[str, Column]:
        part = lambda k: F.nullif(F.get(p["parts"], F.lit(k)), F.lit(""))
        lo, hi = pay_amount(part(0), part(1)), pay_amount(part(2), part(3))
        touches = F.coalesce(part(6).rlike(RANGE_BEFORE), F.lit(False)) | F.coalesce(part(7).rlike(RANGE_AFTER), F.lit(False))
        return {"kind": p["kind"], "lo": F.when(part(3).isNotNull() & part(1).isNull() & (lo < 1000), lo * 1000).otherwise(lo), "hi": hi, "first": F.lower(part(4)), "second": F.lower(part(5)), "touches": touches}

    def built(x: Column) -> Column:
        names = F.create_map(*[F.lit(y) for kv in PAY_SIGNS.items() for y in kv])
        of_sign = F.coalesce(F.upper(_group(text, rf"(?iU)\b({PAY_CODES})\b", 1)), F.try_element_at(names, x["first"]))
        currency = F.when(x["kind"].endswith("signed"), of_sign).when(x["kind"] != "bare", F.upper(F.coalesce(x["second"], x["first"])))
        amounts = lambda lo, hi: F.struct(lo.cast("decimal(38,0)").alias("min"), hi.cast("decimal(38,0)").alias("max"), currency.alias("currency"), lasting.alias("period"))
        ceiling, floor = text.rlike(PAY_CEILING), text.rlike(PAY_FLOOR)
        point = F.when(~x["touches"] & x["lo"].isNotNull(), amounts(F.when(~ceiling, x["lo"]), F.when(ceiling | ~floor, x["lo"])))
        clash = F.coalesce(x["first"] != x["second"], F.lit(False))
        return F.when(x["kind"].startswith("one"), point).when(~clash & (x["lo"] <= x["hi"]), amounts(x["lo"], x["hi"]))

    return _let({"found": found}, lambda p: F.when(p["found"].isNotNull(), _let(read(p["found"]), built)))
