"""Format-preserving pseudonyms for personal data, in SQL expressions only.

A value is validated (Luhn for cards, octet ranges for addresses, calendar for
dates, mod 97 for bank accounts, length for phones), then its letters and digits
go through a keyed Feistel network whose halves are its first and second half of
characters: each round adds, character by character and within the character's
own class, a keyed digest of the other half. Punctuation, length, classes and
check digits stay, equal values get equal pseudonyms in all documents, and the
holder of the key can invert them. Dates go through a Feistel network over the
146,097 = 189 * 773 days of four centuries, which maps dates onto dates; the forms
yyyy-MM-dd, dd.MM.yyyy and MM/dd/yyyy of a day get the same day. Numbers of the form
ddd-dd-dddd go through one over the valid areas, groups and serials, so that valid
ones become valid ones. Mail addresses are linked however A-Z are cased, which stays.

Three passes: the other shapes, accounts, cards. A text that fails validation in one
is open to the next, and validation chooses the extent: an account has its country's
length, and in a stretch of digit groups the longest runs of 13 to 19 digits with a
right check digit are cards, wherever they start.

In mail addresses the letters of ``WIDE`` are permuted too, each within its range; other
characters beyond ASCII stay, and so do host labels that begin with xn--, as few
such labels are valid. Without the secret key nobody can invert the pseudonyms, so
the caller must give one. Documents without personal data change only where a
number passes a check by chance (one in ten digit runs of a card's length does).

Values that fail validation are left alone. Digit groups cost their length but where
possible cards overlap without end (rows of zeros), as only those are weighed together.
Defined results: null text stays null with no values; an empty text or table stays
empty; texts of any length are searched whole; other columns and repeated rows pass
through; an input column named like an added one is replaced.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6

#: The shapes searched for, one alternative each, in this order.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+\-\x80-\uFFFF])[A-Za-z0-9._%+\-\x80-\uFFFF]++@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "secret": r"(?=[TSPAtspa])(?i:token|secret|password|api[_\-]?key)\s{0,3}[=:]\s{0,3}[\"'][A-Za-z0-9+/_\-]{8,}[\"']",
    "address": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "date": r"(?<![\d\-/.])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d\-/])(?!\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])",
    "social": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
}
_NUMERIC = ("address", "date", "phone", "social")
# At most places of a text no alternative can start; one look ahead settles the four of digits.
PATTERN = "|".join(f"(?:{p})" for k, p in SHAPES.items() if k not in _NUMERIC) + "|(?=[0-9+(])(?:" + "|".join(f"(?:{SHAPES[k]})" for k in _NUMERIC) + ")"
#: No shape matches a text without one of these.
HINT = "[0-9@\"']"
ADDED = ("n_values", "kinds")
#: First code point and size of ranges of letters: Latin-1 (four), Latin Extended-A, Greek, Cyrillic, kana, CJK, Hangul.
WIDE = ((0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 8), (0x100, 128), (0x391, 17), (0x3B1, 25), (0x410, 32), (0x430, 32), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172))
_WIDE = "".join(f"\\x{{{low:x}}}-\\x{{{low + size - 1:x}}}" for low, size in WIDE)

#: Characters of an account by country, from the public registry; other countries by the general shape.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_GENERAL = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{c.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + f"|(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')}){_GENERAL})(?![A-Za-z0-9])"
#: Digit groups that may hold cards.
STRETCH = r"(?<!\d)\d[\d \-]{12,}+"
_CARD_DIGITS = range(19, 12, -1)
# Values a pass has found are set in marks; marks of the text itself are escaped by characters no shape begins with.
_OPEN, _CLOSE, _ESCAPE = "\x01", "\x02", "\x03"
_ESCAPED = {_ESCAPE: _ESCAPE + "!", _OPEN: _ESCAPE + "#", _CLOSE: _ESCAPE + "$"}
_DONE = f"{_OPEN}[^{_CLOSE}]*+{_CLOSE}"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def _digest(key: str, tweak: Column, round_no: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, round_no.cast("string"), other), 256)


def _shift(half: Column, digest: Column, letters: Column, wide: bool = False) -> Column:
    """Add the digest to ``half`` within each character's class of 10 digits, ``letters`` letters or a range of ``WIDE``."""

    def one(ch: Column, i: Column, digest: Column) -> Column:
        add = lambda n: F.conv(F.substring(digest, (F.lit(2) * (i % 32) + 1).cast("int"), F.lit(n)), 16, 10).cast("int")
        code = F.ascii(ch)
        turn = lambda low, size: F.char((F.lit(low) + F.pmod(code - low + add(2), size)).cast("long"))
        out = F.when(ch.rlike("[0-9]"), turn(48, F.lit(10))).when(ch.rlike("[a-z]"), turn(97, letters)).when(ch.rlike("[A-Z]"), turn(65, letters))
        for low, size in WIDE if wide else ():
            moved = F.lit(low) + F.pmod(code - low + add(4), F.lit(size))
            out = out.when((code >= low) & (code < low + size), F.decode(F.unhex(F.lpad(F.hex(moved), 4, "0")), "UTF-16BE"))
        return out.otherwise(ch)

    return let(digest, lambda known: F.array_join(F.transform(F.split(half, ""), lambda ch, i: one(ch, i, known)), ""))


def feistel(value: Column, key: str, tweak: str, letters: Column | None = None, rounds: int = ROUNDS, wide: bool = False) -> Column:
    """Permute the ASCII letters and digits (and letters of ``WIDE``) of ``value``; a string of equal format comes out.

    The two halves keep their lengths; an empty half is left as it is.
    """
    if letters is not None:
        return let(F.struct(value.alias("v"), letters.alias("n")), lambda x: _feistel(x["v"], key, tweak, x["n"], rounds, wide))
    return let(value, lambda x: _feistel(x, key, tweak, F.lit(26), rounds, wide))


def _feistel(value: Column, key: str, tweak: str, letters: Column, rounds: int, wide: bool) -> Column:
    half = F.floor(F.length(value) / 2).cast("int")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    for low, size in WIDE if wide else ():
        shape = F.regexp_replace(shape, f"[\\x{{{low:x}}}-\\x{{{low + size - 1:x}}}]", chr(low))
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))

    def run(tag: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            left = F.when(i % 2 == 0, _shift(acc["l"], _digest(key, tag, i, acc["r"]), letters, wide)).otherwise(acc["l"])
            right = F.when(i % 2 == 1, _shift(acc["r"], _digest(key, tag, i, acc["l"]), letters, wide)).otherwise(acc["r"])
            return F.struct(left.alias("l"), right.alias("r"))

        return F.aggregate(F.array(*(F.lit(i) for i in range(rounds))), start, step, lambda acc: F.concat(acc["l"], acc["r"]))

    return let(F.concat_ws("|", F.lit(tweak), shape), run)


def refill(value: Column, symbols: Column, own: str = "A-Za-z0-9") -> Column:
    """Put ``symbols`` (a string) into the places of the characters ``own`` of ``value``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, ch: Column, symbols: Column) -> Column:
        mine = ch.rlike(f"[{own}]")
        return F.struct(F.concat(acc["out"], F.when(mine, F.substring(symbols, acc["at"], F.lit(1))).otherwise(ch)).alias("out"), (acc["at"] + mine.cast("int")).alias("at"))

    return let(symbols, lambda known: F.aggregate(F.split(value, ""), start, lambda acc, ch: step(acc, ch, known), lambda acc: acc["out"]))


def symbols_of(value: Column, own: str = "A-Za-z0-9") -> Column:
    return F.regexp_replace(value, f"[^{own}]", "")


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum; ``doubled_last`` for digits that still lack their check digit."""

    def one(ch: Column, i: Column) -> Column:
        d = ch.cast("int")
        twice = i % 2 == (0 if doubled_last else 1)
        return F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + x)


def mod97(symbols: Column) -> Column:
    """Value modulo 97 of digits and letters A-Z read as 10 to 35."""
    return F.aggregate(
        F.split(symbols, ""),
        F.lit(0),
        lambda a, ch: F.when(ch.rlike("[0-9]"), (a * 10 + ch.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(ch) - 55) % 97),
    )


def _card(value: Column, key: str) -> Column:
    def filled(body: Column) -> Column:
        return F.concat(body, ((10 - luhn_sum(body, True) % 10) % 10).cast("string"))

    def checked(digits: Column) -> Column:
        new = let(feistel(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card"), filled)
        return F.when(luhn_sum(digits, False) % 10 == 0, refill(value, new))

    return let(symbols_of(value), checked)


def _iban(value: Column, key: str) -> Column:
    def checked(s: Column) -> Column:
        country, body = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))

        def filled(new: Column) -> Column:
            return F.concat(country, F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)

        valid = mod97(F.concat(body, country, F.substring(s, 3, 2))) == 1
        return F.when(valid, refill(value, let(feistel(body, key, "iban"), filled)))

    return let(symbols_of(value), checked)


def _address(value: Column, key: str) -> Column:
    """Feistel over the two 16-bit halves of the address."""
    octets = F.transform(F.split(value, "\\."), lambda x: x.cast("int"))
    start = F.struct((octets[0] * 256 + octets[1]).alias("l"), (octets[2] * 256 + octets[3]).alias("r"))
    add = lambda i, other: F.conv(F.substring(_digest(key, F.lit("address"), i, other.cast("string")), 1, 6), 16, 10).cast("int")

    def step(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(acc["l"] + add(i, acc["r"]), F.lit(65536))).otherwise(acc["l"])
        right = F.when(i % 2 == 1, F.pmod(acc["r"] + add(i, acc["l"]), F.lit(65536))).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    render = lambda a: F.concat_ws(".", *(x.cast("string") for x in (F.floor(a["l"] / 256), a["l"] % 256, F.floor(a["r"] / 256), a["r"] % 256)))
    return F.when(F.array_max(octets) <= 255, F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, step, render))


def _mixed(number: Column, key: str, tweak: str, m: int, n: int) -> Column:
    """Feistel over the numbers below ``m * n``, by quotient and remainder of ``n``."""
    add = lambda i, other: F.conv(F.substring(_digest(key, F.lit(tweak), i, other.cast("string")), 1, 6), 16, 10).cast("int")
    start = F.struct(F.floor(number / n).cast("int").alias("l"), (number % n).cast("int").alias("r"))

    def step(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(acc["l"] + add(i, acc["r"]), F.lit(m))).otherwise(acc["l"])
        right = F.when(i % 2 == 1, F.pmod(acc["r"] + add(i, acc["l"]), F.lit(n))).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, step, lambda a: a["l"].cast("long") * n + a["r"])


#: The forms of dates, by the separator.
DATE_FORMS = {"-": "yyyy-MM-dd", ".": "dd.MM.yyyy", "/": "MM/dd/yyyy"}


def _date(value: Column, key: str) -> Column:
    """Feistel over 189 * 773 days from 1800-01-01; later or earlier days are not personal dates."""
    out = F.lit(None).cast("string")
    for mark, form in DATE_FORMS.items():
        day = F.datediff(F.try_to_date(value, form), F.lit("1800-01-01").cast("date"))
        moved = F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), _mixed(day, key, "date", 189, 773).cast("int")), form)
        out = F.when(value.contains(mark), F.when((day >= 0) & (day < 146_097), moved)).otherwise(out)
    return out


def _email(value: Column, key: str) -> Column:
    """Local part and host labels; the top-level domain and labels that begin with xn-- stay."""
    own, coded = "A-Za-z0-9" + _WIDE, r"(?i)(?<=[@.])xn--[a-z0-9\-]+"
    head, top = F.regexp_extract(value, r"^(.*)\.[A-Za-z]+$", 1), F.regexp_extract(value, r"\.[A-Za-z]+$", 0)

    def moved(plain: Column) -> Column:
        low = F.translate(plain, ascii_uppercase, ascii_lowercase)
        cased = lambda new: F.array_join(F.zip_with(F.split(new, ""), F.split(plain, ""), lambda a, b: F.when(b.rlike("[A-Z]"), F.upper(a)).otherwise(a)), "")
        return let(refill(low, feistel(symbols_of(low, own), key, "email", wide=True), own), lambda new: F.when(low == plain, new).otherwise(cased(new)))

    # Coded labels wait outside and come back between the parts.
    labels = F.regexp_extract_all(head, F.lit(coded), F.lit(0))
    parts = F.split(moved(F.regexp_replace(head, coded, _OPEN)), _OPEN, -1)
    whole = F.array_join(F.flatten(F.zip_with(parts, F.concat(labels, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return F.concat(F.when(head.rlike(coded), whole).otherwise(moved(head)), top)


def _secret(value: Column, key: str) -> Column:
    inner = F.regexp_extract(value, "[\"']([^\"']*)[\"']$", 1)
    letters = F.when(inner.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 6).otherwise(26)
    head = F.substring(value, F.lit(1), F.length(value) - F.length(inner) - 1)
    return F.concat(head, refill(inner, feistel(symbols_of(inner), key, "secret", letters)), F.right(value, F.lit(1)))


def _phone(value: Column, key: str) -> Column:
    """The country code stays; seven to fifteen digits make a number."""
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .\-(])", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    n = F.length(symbols_of(value))
    return F.when((n >= 7) & (n <= 15), F.concat(code, refill(rest, feistel(symbols_of(rest), key, "phone"))))


def _social(value: Column, key: str) -> Column:
    """Area not 000, 666 or 9xx, group not 00, serial not 0000: 898 * 99 by 9,999 numbers."""
    valid = value.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")
    area, group, serial = F.substring(value, 1, 3).cast("int"), F.substring(value, 5, 2).cast("int"), F.substring(value, 8, 4).cast("int")
    number = ((area - 1 - (area > 666).cast("int")) * 99 + group - 1).cast("long") * 9_999 + serial - 1

    def shown(moved: Column) -> Column:
        head, area = F.floor(moved / 9_999), F.floor(moved / (99 * 9_999)) + 1
        parts = ((area + (area > 665).cast("int"), 3), (head % 99 + 1, 2), (moved % 9_999 + 1, 4))
        return F.concat_ws("-", *(F.lpad(n.cast("string"), width, "0") for n, width in parts))

    return F.when(valid, let(_mixed(number, key, "social", 898 * 99, 9_999), shown))


_RULES = {"email": _email, "secret": _secret, "address": _address, "date": _date, "phone": _phone, "social": _social}


def _judge(value: Column, key: str) -> Column:
    """Kinds and new text of one match, by the first shape it fits; no kinds and the old text if it doesn't validate."""
    kind = F.lit(None).cast("string")
    for name in reversed(_RULES):
        kind = F.when(value.rlike(f"^(?:{SHAPES[name]})$"), name).otherwise(kind)

    def renamed(kind: Column) -> Column:
        new = F.lit(None).cast("string")
        for name, rule in reversed(_RULES.items()):
            new = F.when(kind == name, rule(value, key)).otherwise(new)
        return let(new, lambda new: _found(value, kind, new))

    return let(kind, renamed)


def _marked(new: Column) -> Column:
    return F.concat(F.lit(_OPEN), new, F.lit(_CLOSE))


def _found(value: Column, kind: Column, new: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(F.when(new.isNotNull(), F.array(kind)).otherwise(none).alias("kinds"), F.coalesce(_marked(new), value).alias("new"))


def _judge_iban(value: Column, key: str) -> Column:
    return let(F.when(~value.startswith(_OPEN), _iban(value, key)), lambda new: _found(value, F.lit("iban"), new))


def _judge_stretch(value: Column, key: str) -> Column:
    """The longest valid runs of the digit groups, none overlapping another.

    Groups between which no valid run leads are judged apart, so that runs are compared with near ones only.
    """

    def runs(groups: Column, at: Column) -> Column:
        near = F.array_join(F.slice(groups, at, 20), "")
        sized = lambda near: F.array(*(F.regexp_extract(near, rf"^[ \-]?(\d(?:[ \-]?\d){{{n - 1}}})(?!\d)", 1) for n in _CARD_DIGITS))
        fit = F.filter(let(near, sized), lambda run: (run != "") & (luhn_sum(symbols_of(run), False) % 10 == 0))
        return F.transform(fit, lambda run: F.struct((-F.length(symbols_of(run))).alias("less"), at.alias("at"), F.size(F.split(run, "[ \\-]")).alias("n"), run.alias("run")))

    def chosen(near: Column) -> Column:
        every = F.array_sort(F.flatten(near))
        none = F.filter(every, lambda x: F.lit(False))
        meets = lambda x: lambda y: (x["at"] < y["at"] + y["n"]) & (y["at"] < x["at"] + x["n"])
        return F.aggregate(every, none, lambda acc, x: F.when(F.exists(acc, meets(x)), acc).otherwise(F.concat(acc, F.array(x))))

    def renamed(groups: Column, begin: Column, taken: Column) -> Column:
        def one(group: Column, i: Column) -> Column:
            at = begin + i
            mine = F.filter(taken, lambda x: (x["at"] <= at) & (at < x["at"] + x["n"]))
            first = F.concat(F.regexp_extract(group, "^[ \\-]?", 0), _marked(_card(mine[0]["run"], key)))
            return F.when(F.size(mine) == 0, group).when(mine[0]["at"] == at, first).otherwise("")

        return F.struct(F.transform(taken, lambda x: F.lit("card")).alias("kinds"), F.array_join(F.transform(groups, one), "").alias("new"))

    plain = F.struct(F.array().cast("array<string>").alias("kinds"), value.alias("new"))

    def parted(groups: Column, found: Column) -> Column:
        # A part begins at a group into which none of the 18 before it leads.
        ends = F.transform(found, lambda near, i: i + 1 + F.coalesce(F.array_max(F.transform(near, lambda x: x["n"])), F.lit(0)))
        begins = lambda ends: F.filter(F.sequence(F.lit(1), F.size(groups)), lambda at: (at == 1) | (F.array_max(F.slice(ends, F.greatest(at - 18, F.lit(1)), F.least(at - 1, F.lit(18)))) <= at))

        def part(begin: Column, size: Column) -> Column:
            texts, near = F.slice(groups, begin, size), F.slice(found, begin, size)
            untouched = F.struct(F.array().cast("array<string>").alias("kinds"), F.array_join(texts, "").alias("new"))
            return let(chosen(near), lambda taken: F.when(F.size(taken) == 0, untouched).otherwise(renamed(texts, begin, taken)))

        def joined(begins: Column) -> Column:
            nexts = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(F.size(groups) + 1))
            parts = F.zip_with(begins, nexts, lambda a, b: part(a, b - a))
            return let(parts, lambda parts: F.struct(F.flatten(F.transform(parts, lambda p: p["kinds"])).alias("kinds"), F.array_join(F.transform(parts, lambda p: p["new"]), "").alias("new")))

        return let(let(ends, begins), joined)

    found = lambda groups: F.transform(F.sequence(F.lit(1), F.size(groups)), lambda at: runs(groups, at))
    split = let(F.split(value, "(?=[ \\-])"), lambda groups: let(found(groups), lambda found: parted(groups, found)))
    return F.when(value.startswith(_OPEN), plain).otherwise(split)


def _pass(docs: DataFrame, column: str, pattern: str, hint: str, judge) -> DataFrame:
    """Put what ``judge`` makes of each match in its place and add its kinds to ``_kinds``."""
    # Parts and matches are bound once per row, and texts without matches skip the rebuilding.
    none = F.array().cast("array<string>")
    whole = docs.withColumn("_matches", F.transform(F.when(F.col(column).rlike(hint), F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).otherwise(none), judge))
    parts = F.split(F.col(column), pattern, -1)
    new = F.concat(F.transform("_matches", lambda m: m["new"]), F.array(F.lit("")))
    text = F.when(F.size("_matches") > 0, F.array_join(F.flatten(F.zip_with(parts, new, lambda a, b: F.array(a, b))), "")).otherwise(F.col(column))
    return whole.withColumns({column: text, "_kinds": F.concat("_kinds", F.flatten(F.transform("_matches", lambda m: m["kinds"])))}).drop("_matches")


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Replace the validated values of ``column`` under the secret ``key``; add ``n_values`` and sorted distinct ``kinds``."""
    docs = docs.drop(*(c for c in docs.columns if c in ADDED))
    text = F.col(column)
    own = text.rlike(f"[{_OPEN}{_CLOSE}{_ESCAPE}]")
    escaped, plain = text, F.translate(text, _OPEN + _CLOSE, "")
    for raw, safe in _ESCAPED.items():
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    for raw, safe in reversed(_ESCAPED.items()):
        plain = F.replace(plain, F.lit(safe), F.lit(raw))
    out = docs.withColumns({column: F.when(own, escaped).otherwise(text), "_kinds": F.array().cast("array<string>")})
    out = _pass(out, column, PATTERN, HINT, lambda m: _judge(m, key))
    out = _pass(out, column, f"{_DONE}|{IBAN}", "[A-Z]{2}[0-9]{2}", lambda m: _judge_iban(m, key))
    out = _pass(out, column, f"{_DONE}|{STRETCH}", "[0-9][0-9 \\-]{12}", lambda m: _judge_stretch(m, key))
    added = {"n_values": F.size("_kinds").cast("long"), "kinds": F.array_sort(F.array_distinct("_kinds"))}
    return out.withColumns({column: F.when(text.rlike(f"[{_OPEN}{_ESCAPE}]"), plain).otherwise(text), **added}).drop("_kinds")
