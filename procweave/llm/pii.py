"""Personal data and secrets replaced by format-preserving pseudonyms, as DataFrame expressions.

Found are e-mail addresses, phone numbers, IPv4 addresses, payment card numbers, dates, social
security numbers, IBANs, access keys and secrets after a word like `token =`. What has a rule to
check is validated first: octets are at most 255 and without leading zeros, card numbers pass the
Luhn check, IBANs that of mod 97, dates exist, social security numbers have an area, a group and a
serial. What fails is left as it is. An address's host has at most 127 labels, as in DNS.

Dates are written as 2024-02-29, also before a `T`, or by two numbers and the year, with slashes,
dots or hyphens between: month first, with dots day first, and the other way round where only that
is a date. Phone numbers are written with `+`, with `(ddd)`, or as 212-555-0134 or 212.555.0134.

A card number may stand beside other numbers, so in a run of digit groups every window of 13 to 19
digits between groups' borders is checked. Where valid ones overlap, likely ones (16 digits from 2 to
6, 15 digits of 34 or 37) come before others, which are then taken for chance. Among equals the first
is taken, and the rest of the others is replaced too.

A value is replaced under a key by a value of its own format, always by the same one, so equal
values stay linked across documents, and different values stay different:

* Strings: a Feistel network over the two halves of the value's letters and digits. A round shifts
  each character of one half within its class (a-z, A-Z, 0-9, or 0-9a-f for lower hexadecimal) by
  a keyed hash of the other half. Marks between stay.
* Card numbers: the digits but the last, so; the last is the Luhn digit of the new ones.
* IBANs: what follows the check digits, so; the check digits are those of the new number.
* Dates, 1800 to 2199: the day's number in a cycle of 400 years, 146097 = 189 * 773 days, by a
  Feistel network over Z_189 x Z_773, so the result exists.
* IPv4: the 32 bits by a Feistel network over two halves of 16.

Each network is a permutation of its domain. Where only a part of the domain is valid (social security
numbers, phone numbers, days whose form must stay readable as it was), it is applied until the result
is valid again, which is a permutation of the part; WALKS turns are enough but for a chance under 1e-20.
So within a kind and form no two values meet. Null stays null, a text without findings stays as it
is; texts of any length are taken whole, and no pattern or step takes more than a bounded stack or
time that grows faster than the text. Rows stay, repeated ones too, as do other columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of a network, and the most turns of one until a result is valid.
ROUNDS, WALKS = 8, 64

#: What is looked for, as Java patterns; the first that matches at a place counts. Java walks the turns of
#: a greedy group on its stack, so such groups have bounds and all others are possessive.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}"
SECRET = r"(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key)\b\s*[=:]\s*[\"']?)[A-Za-z0-9_/+-]{8,}"
ACCESS_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)\b"
YEAR = "(?:18|19|20|21)[0-9]{2}"
ISO_DATE = rf"\b{YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?:\b|(?=T[0-9]))"
DAY_MONTH = "|".join(rf"[0-3]?[0-9]{m}[0-3]?[0-9]{m}" for m in ("/", r"\.", "-"))
DATE = rf"(?:{ISO_DATE}|(?<![0-9A-Za-z/.-])(?:{DAY_MONTH}){YEAR}(?![0-9A-Za-z/-]|\.[0-9]))"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PLAIN_PHONE = r"(?:1[.-])?[2-9][0-9]{2}(?:-[2-9][0-9]{2}-|\.[2-9][0-9]{2}\.)[0-9]{4}"
PHONE = rf"(?<![0-9A-Za-z])\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{2,4}}\)?(?:[ .-]?[0-9]{{2,4}}){{2,4}}(?![0-9])|\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}(?![0-9])|(?<![0-9A-Za-z.-]){PLAIN_PHONE}(?![0-9A-Za-z-]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
#: Groups of digits that may hold cards, up to one that belongs to another finding or to a word.
RUN = rf"(?<![0-9A-Za-z-])(?={CARD})[0-9]++(?![A-Za-z]|-(?![0-9]))(?:[ -](?!{DATE}|{SSN})[0-9]++(?![A-Za-z]|-(?![0-9])|\.[0-9]|[A-Za-z0-9._%+-]{{0,64}}+@))*+"
ANY = "|".join((EMAIL, SECRET, ACCESS_KEY, IBAN, DATE, IP, PHONE, SSN, RUN))
#: Lengths of cards, in the order in which windows with the same start are taken, and the likely ones.
CARD_DIGITS = (16, 15, 14, 13, 19, 18, 17)
LIKELY = r"^(?:[2-6](?:[ -]?[0-9]){15}|3[ -]?[47](?:[ -]?[0-9]){13})$"
#: Groups of a run that are walked at a time.
RUN_BLOCK = 500
#: No finding lacks all of these; a test that is cheaper than ANY.
HINT = r"[0-9@=:]"

LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _number(hex_text: Column, digits: int) -> Column:
    return F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("long")


def _hash(key: str, use: str | Column, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(use), turn.cast("string"), value), 256)


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def feistel(left: Column, right: Column, step, rounds: int = ROUNDS) -> Column:
    """A struct (l, r) after rounds of (l, r) -> (r, step(turn, l, r)); each step must be reversible given r."""
    start = F.struct(left.alias("l"), right.alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, turn: F.struct(s["r"].alias("l"), step(turn, s["l"], s["r"]).alias("r")))


def walked(value: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """value after one step, and after more until it is valid: a permutation of the valid values if step is one."""
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))
    turn = lambda s: _let(step(s["v"]), lambda v: F.struct(v.alias("v"), valid(v).alias("done")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda s, _: F.when(s["done"], s).otherwise(turn(s)), lambda s: s["v"])


def _shifted(key: str, use: str | Column, turn: Column, half: Column, other: Column) -> Column:
    """Each letter or digit of half moved within its class by the hash of the other half.

    The other half is hashed once; 16 characters take their numbers from a hash of that and their block's place."""
    n = F.char_length(half)
    block = lambda seed: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int")), lambda k: F.sha2(F.concat_ws("|", seed, k.cast("string")), 256))

    def one(c: Column, i: Column, blocks: Column) -> Column:
        by = F.conv(F.substring(blocks[F.floor(i / 16).cast("int")], (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("long")
        alphabet = F.when((F.lit(use) == "hex") & F.contains(F.lit(HEX), c), HEX).when(c.between("a", "z"), LOWER).when(c.between("A", "Z"), UPPER).when(c.between("0", "9"), DIGITS)
        moved = lambda a: F.substring(a, ((F.call_function("instr", a, c) - 1 + by) % F.char_length(a) + 1).cast("int"), F.lit(1))
        return _let(alphabet, lambda a: F.when(a.isNull(), c).otherwise(moved(a)))

    moved = _let(_let(_hash(key, use, turn, other), block), lambda blocks: F.array_join(F.transform(_chars(half), lambda c, i: one(c, i, blocks)), ""))
    return F.when(n > 0, moved).otherwise(half)


def permute_text(value: Column, key: str, use: str | Column) -> Column:
    """A permutation of strings that keeps each character's class and place. use: what the value is for; values
    of different uses are permuted by themselves, and `hex` takes 0-9 and a-f for one class. One character
    alone has no half to be moved by but the empty one."""
    half = F.floor(F.char_length(value) / 2).cast("int")
    left, right = F.substring(value, F.lit(1), half), F.substring(value, half + 1, F.char_length(value))
    # halves change places each round; after an even number the first half is the first again
    out = feistel(left, right, lambda turn, l, r: _shifted(key, use, turn, l, r))  # noqa: E741
    return _let(out, lambda s: F.concat(s["l"], s["r"]))


def _in_place(value: Column, plain: Column, moved: Column) -> Column:
    """value with its characters of `plain`, in order, replaced by those of `moved`."""
    start = F.struct(F.lit("").alias("done"), F.lit(1).alias("next"))

    def step(s: Column, c: Column) -> Column:
        taken = c == F.substring(plain, s["next"], F.lit(1))
        return F.struct(F.concat(s["done"], F.when(taken, F.substring(moved, s["next"], F.lit(1))).otherwise(c)).alias("done"), (s["next"] + taken.cast("int")).alias("next"))

    return F.aggregate(_chars(value), start, step, lambda s: s["done"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def permute_digits(value: Column, key: str, use: str | Column) -> Column:
    """The digits permuted, the marks between them as they are."""
    return _let(_digits(value), lambda p: _in_place(value, p, permute_text(p, key, use)))


def luhn_sum(digits: Column, skip_last: int) -> Column:
    """The Luhn sum of a digit string that lacks its check digit (skip_last=1) or has it (0)."""
    weighed = lambda d, i: F.when((i + 1 + skip_last) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.transform(F.reverse(_chars(digits)), lambda c, i: weighed(c.cast("int"), i)), F.lit(0), lambda a, b: a + b)


def permute_card(value: Column, key: str) -> Column:
    """The digits but the last permuted, the last made to pass the Luhn check."""
    with_check = lambda b: F.concat(b, ((10 - luhn_sum(b, 1) % 10) % 10).cast("string"))
    body = lambda plain: permute_text(F.substring(plain, F.lit(1), F.char_length(plain) - 1), key, "card")
    return _let(_digits(value), lambda plain: _let(_let(body(plain), with_check), lambda m: _in_place(value, plain, m)))


def _is_run(value: Column) -> Column:
    return value.rlike("^[0-9][0-9 -]*+$") & (F.char_length(_digits(value)) >= min(CARD_DIGITS))


def cards_of(run: Column) -> Column:
    """A run of digit groups as an array of structs (value, kind) that make it up: cards and what stands between.

    What becomes of each group is a letter: c, a card starts; i, inside one; r, what is left of a window that a
    card overlaps; p, plain. The walk that finds them goes through blocks of RUN_BLOCK groups, which keeps its
    work in proportion to the groups."""
    starts = lambda n: F.regexp_extract_all(run, F.lit(rf"(?<![0-9])(?=[0-9])(?=([0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9]))?)"), F.lit(1))
    valid = lambda w: F.when(F.when(w != "", luhn_sum(_digits(w), 0) % 10 == 0).otherwise(False), w)
    windows = F.arrays_zip(*[starts(n).alias(f"w{n}") for n in CARD_DIGITS], F.regexp_extract_all(run, F.lit("([ -]?[0-9]+)"), F.lit(1)).alias("group"))
    likely = lambda w: F.get(F.filter(w, lambda c: c.rlike(LIKELY)), F.lit(0))
    size = lambda v: F.char_length(_digits(v))
    item = lambda v, kind: F.struct(v.alias("value"), F.lit(kind).cast("string").alias("kind"))

    def described(x: Column) -> Column:
        cards = F.array_compact(F.array(*[valid(x[f"w{n}"]) for n in CARD_DIGITS]))
        chosen = _let(cards, lambda w: _let(likely(w), lambda sure: F.struct(F.coalesce(sure, F.get(w, F.lit(0))).alias("card"), sure.isNotNull().alias("likely"))))
        return _let(chosen, lambda c: F.struct(
            x["group"].alias("group"), F.regexp_extract(x["group"], "^([ -]?)", 1).alias("mark"), size(x["group"]).alias("digits"),
            c["card"].alias("card"), c["likely"].alias("likely"), size(c["card"]).alias("card_digits"), (F.size(F.split(c["card"], "[ -]")) - 1).alias("inside"),
        ))

    def opened(found: Column) -> Column:
        """Without the cards that are unlikely and have a likely one start inside."""
        later = lambda f, i: F.exists(F.slice(found, i + 2, F.greatest(f["inside"], F.lit(0))), lambda x: x["likely"])
        spared = lambda f, i: F.when(f["likely"], False).when(f["card"].isNull(), False).otherwise(later(f, i))
        return F.transform(found, lambda f, i: F.struct(*[f[c].alias(c) for c in ("group", "mark", "digits", "card", "likely")], F.when(~spared(f, i), f["card_digits"]).alias("card_digits")))

    state = lambda codes, left, ahead, sure: F.struct(codes.alias("codes"), F.greatest(left, F.lit(0)).alias("left"), F.greatest(ahead, F.lit(0)).alias("ahead"), sure.alias("sure"))

    def step(s: Column, x: Column) -> Column:
        digits, coming = x["digits"], x["card_digits"]
        counts = (s["left"] == 0) | ~s["sure"] | x["likely"]  # else chance beside a likely card
        ahead = F.greatest(s["ahead"], F.coalesce(F.when(counts, coming), F.lit(0))) - digits
        on = lambda code: F.concat(s["codes"], F.lit(code))
        return (
            F.when(s["left"] > 0, state(on("i"), s["left"] - digits, ahead, s["sure"]))
            .when(coming.isNotNull(), state(on("c"), coming - digits, ahead, x["likely"]))
            .when(s["ahead"] > 0, state(on("r"), F.lit(0), ahead, s["sure"]))
            .otherwise(state(on("p"), F.lit(0), ahead, s["sure"]))
        )

    def codes(found: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN_BLOCK).cast("int")), lambda k: F.slice(found, k * RUN_BLOCK + 1, F.lit(RUN_BLOCK)))
        inner = lambda s, own: F.aggregate(own, state(F.lit(""), s["left"], s["ahead"], s["sure"]), step)
        block = lambda s, own: _let(inner(s, own), lambda t: state(F.concat(s["codes"], t["codes"]), t["left"], t["ahead"], t["sure"]))
        return F.aggregate(blocks, state(F.lit(""), F.lit(0), F.lit(0), F.lit(False)), block, lambda s: s["codes"])

    def items(x: Column, code: Column) -> Column:
        own = F.substring(x["group"], F.char_length(x["mark"]) + 1, F.char_length(x["group"]))
        none = F.array().cast("array<struct<value:string,kind:string>>")
        return F.when(code == "p", F.array(item(x["group"], None))).when(code == "c", F.array(item(x["mark"], None), item(x["card"], "card"))).when(code == "r", F.array(item(x["mark"], None), item(own, "rest"))).otherwise(none)

    return _let(_let(F.transform(windows, described), opened), lambda found: F.flatten(F.zip_with(found, _chars(codes(found)), items)))


#: Days of the 400 years from 1800-01-01; two factors of 146097.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773


def dated(value: Column) -> Column:
    """A struct (day, form) of a written date, null if it names none: the day, and how it is written,
    the first field's name (Y, M or D), the mark, and the fields' least width."""
    date = lambda o: F.try_to_date(F.concat_ws("-", o["y"], F.lpad(o["m"], 2, "0"), F.lpad(o["d"], 2, "0")), "yyyy-MM-dd")
    way = lambda p, order: F.struct(F.lit(order).alias("order"), *[F.get(p, F.lit(order.index(f))).alias(f.lower()) for f in "YMD"])
    ways = lambda p, mark: F.when(F.char_length(p[0]) == 4, F.array(way(p, "YMD"))).when(mark == ".", F.array(way(p, "DMY"), way(p, "MDY"))).otherwise(F.array(way(p, "MDY"), way(p, "DMY")))
    width = lambda p: F.when(F.exists(p, lambda x: F.char_length(x) == 1), "1").otherwise("2")
    read = lambda p, mark: F.transform(ways(p, mark), lambda o: F.struct(date(o).alias("day"), F.concat(F.substring(o["order"], 1, 1), mark, width(p)).alias("form")))
    found = lambda v: _let(F.split(v, "[/.-]"), lambda p: _let(F.regexp_extract(v, "([/.-])", 1), lambda mark: F.filter(read(p, mark), lambda x: x["day"].isNotNull())))
    return F.get(_let(value, found), F.lit(0))


def _written(day: Column, form: Column) -> Column:
    pattern = F.when(form.startswith("Y"), "yyyy-MM-dd").when(form.startswith("M"), "MM-dd-yyyy").otherwise("dd-MM-yyyy")
    narrow = F.when(form.endswith("1"), F.replace(F.replace(pattern, F.lit("MM"), F.lit("M")), F.lit("dd"), F.lit("d"))).otherwise(pattern)
    return F.call_function("date_format", day, F.replace(narrow, F.lit("-"), F.substring(form, 2, 1)))


def permute_day(day: Column, key: str) -> Column:
    start = F.lit(FIRST_DAY).cast("date")
    number = F.datediff(day, start).cast("long")
    half = lambda turn, l, r: F.pmod(l + _number(_hash(key, "date", turn, r.cast("string")), 12), F.when(turn % 2 == 1, DAYS_A).otherwise(DAYS_B))  # noqa: E731,E741
    out = feistel(F.pmod(number, F.lit(DAYS_A)), F.floor(number / DAYS_A).cast("long"), half)
    return _let(out, lambda s: F.date_add(start, (s["r"] * DAYS_A + s["l"]).cast("int")))


def permute_date(value: Column, key: str) -> Column:
    """A date of the same form, read the same way as the value."""
    same = lambda d, form: F.coalesce(dated(_written(d, form))["form"] == form, F.lit(False))
    return _let(dated(value), lambda x: _written(walked(x["day"], lambda d: permute_day(d, key), lambda d: same(d, x["form"])), x["form"]))


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and letters, A being 10 and Z 35."""
    code = lambda c: F.ascii(c)
    return F.aggregate(_chars(text), F.lit(0), lambda n, c: F.when(code(c) < 58, (n * 10 + code(c) - 48) % 97).otherwise((n * 100 + code(c) - 55) % 97))


def is_iban(value: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))
    return F.char_length(plain).between(15, 34) & F.substring(plain, 3, 2).between("02", "98") & (mod97(turned) == 1)


def permute_iban(value: Column, key: str) -> Column:
    def moved(plain: Column) -> Column:
        country = F.substring(plain, 1, 2)
        with_check = lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
        new = _let(permute_text(F.substring(plain, F.lit(5), F.char_length(plain)), key, "iban"), with_check)
        return _let(new, lambda m: _in_place(value, plain, m))

    return _let(F.regexp_replace(value, " ", ""), moved)


def permute_ip(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, "\\."), lambda x: x.cast("long"))
    half = lambda turn, l, r: l.bitwiseXOR(_number(_hash(key, "ip", turn, r.cast("string")), 4))  # noqa: E731,E741
    out = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], half)
    return _let(out, lambda s: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)]))


def _part(text: Column, use: str | Column | None = None) -> Column:
    return F.struct(text.alias("text"), F.lit(use).cast("string").alias("use"))


def _from(value: Column, place: Column) -> Column:
    return F.substring(value, place, F.char_length(value))


def _email(value: Column) -> Column:
    """The name permuted; the domain too but for its last label."""
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.char_length(domain) - F.char_length(top) - 1)
    return F.array(_part(name, "name"), _part(F.lit("@")), _part(host, "host"), _part(F.concat(F.lit("."), top)))


def _secret(value: Column) -> Column:
    """What stands after the name and the sign: lower hexadecimal stays so, else letters and digits by class."""
    name = F.regexp_extract(value, r"^((?i:token|password|passwd|pwd|secret|api[_-]?key)\s*[=:]\s*[\"']?)", 1)
    rest = _from(value, F.char_length(name) + 1)
    return F.array(_part(name), _part(rest, F.when(rest.rlike("^[0-9a-f]+$"), "hex").otherwise("secret")))


def _phone(value: Column) -> Column:
    """The country's prefix stays."""
    prefix = F.regexp_extract(value, r"^(\+[0-9]{1,3}[ .(-]+|\+[0-9]|1[.-])", 1)
    return F.array(_part(prefix), _part(_from(value, F.char_length(prefix) + 1), "phone"))


def _is_ssn(value: Column) -> Column:
    return ~value.rlike("^(000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    """valid: the check of what the pattern finds, if it has one. parts: the pieces (text, use) of a value that is
    permuted by characters; those without a use stay. replace: how another value is permuted."""

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None = None
    parts: Callable[[Column], Column] | None = None
    replace: Callable[[Column, str], Column] | None = None


KINDS = (
    Kind("email", EMAIL, parts=_email),
    Kind("secret", SECRET, parts=_secret),
    Kind("access_key", ACCESS_KEY, parts=lambda v: F.array(_part(F.substring(v, 1, 4)), _part(_from(v, F.lit(5)), "access"))),
    Kind("date", DATE, lambda v: dated(v)["day"].isNotNull(), replace=permute_date),
    Kind("ip", IP, lambda v: F.forall(F.split(v, "\\."), lambda x: (x.cast("int") <= 255) & ~x.rlike("^0[0-9]")), replace=permute_ip),
    Kind("ssn", SSN, _is_ssn, lambda v: F.array(_part(v, "ssn"))),
    Kind("phone", PHONE, lambda v: F.char_length(_digits(v)).between(8, 15), _phone),
    Kind("card", CARD, lambda v: F.char_length(_digits(v)).between(13, 19) & (luhn_sum(_digits(v), 0) % 10 == 0), replace=permute_card),
    Kind("iban", IBAN, is_iban, replace=permute_iban),
)
#: What is left of a card's window where another card overlaps it: no kind of its own.
REST = "rest"


def _permuted(part: Column, key: str) -> Column:
    """A part's text permuted: digits between marks, which must stay a valid number, or letters and digits."""
    valid = lambda v: F.when(part["use"] == "ssn", _is_ssn(v)).when((part["use"] == "phone") & part["text"].rlike(f"^{PLAIN_PHONE}$"), v.rlike(f"^{PLAIN_PHONE}$")).otherwise(True)
    digits = walked(part["text"], lambda v: permute_digits(v, key, part["use"]), valid)
    return F.when(part["use"].isNull(), part["text"]).when(part["use"].isin("ssn", "phone", REST), digits).otherwise(permute_text(part["text"], key, part["use"]))


def kind_of(value: Column) -> Column:
    """The kind of a finding; null if it fails its kind's check."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        fits = value.rlike(f"^(?:{kind.pattern})$")
        out = F.when(F.when(fits, kind.valid(value)).otherwise(False) if kind.valid else fits, F.lit(kind.name)).otherwise(out)
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    parts = F.when(kind == REST, F.array(_part(value, REST)))
    for k in KINDS:
        if k.parts:
            parts = parts.when(kind == k.name, k.parts(value))
    out = F.when(kind.isNull(), value)
    for k in KINDS:
        if k.replace:
            out = out.when(kind == k.name, k.replace(value, key))
    return out.otherwise(F.array_join(F.transform(parts, lambda p: _permuted(p, key)), ""))


def _parts(docs: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """docs with an array for each match of ANY: the structs (value, kind, pseudonym) that make it up; null for texts without."""
    body = F.col(text)
    raw = F.when(body.rlike(HINT), F.regexp_extract_all(body, F.lit(f"({ANY})"), F.lit(1)))
    known = lambda v: F.array(F.struct(v.alias("value"), kind_of(v).alias("kind")))
    # a word in capitals after an IBAN in groups may look like its last group
    account = lambda v: F.regexp_extract(v, "^([A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+) [A-Z0-9]{1,4}$", 1)
    cut = lambda v, a: F.array(F.struct(a.alias("value"), F.lit("iban").alias("kind")), F.struct(F.substring(v, F.char_length(a) + 1, F.char_length(v)).alias("value"), F.lit(None).cast("string").alias("kind")))
    kinds = lambda v: F.when(_is_run(v), cards_of(v)).when(v.rlike("^[A-Z]{2}[0-9]{2} ") & ~is_iban(v) & is_iban(account(v)), cut(v, account(v))).otherwise(known(v))
    described = lambda v: F.transform(kinds(v), lambda s: F.struct(s["value"].alias("value"), s["kind"].alias("kind"), pseudonym(s["value"], s["kind"], key).alias("pseudonym")))
    return docs.withColumn("__pw_raw", raw).withColumn(out, F.when(F.size("__pw_raw") > 0, F.transform("__pw_raw", described))).drop("__pw_raw")


def findings(docs: DataFrame, key: str, text: str = "text", out: str = "__pw_found") -> DataFrame:
    """docs with an array of structs (value, kind, pseudonym) in text order; null for texts without."""
    return _parts(docs, key, text, out).withColumn(out, F.flatten(out))


def pseudonymized(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with every valid finding of the text replaced; all rows and columns stay."""
    found = _parts(docs, key, text, "__pw_parts")
    gaps = F.split(F.col(text), ANY, -1)
    new = lambda b: F.array_join(F.transform(b, lambda x: x["pseudonym"]), "")
    join = lambda g: F.concat(F.array_join(F.zip_with(F.slice(g, F.lit(1), F.size(g) - 1), F.col("__pw_parts"), lambda a, b: F.concat(a, new(b))), ""), F.element_at(g, -1))
    moved = F.when(F.col("__pw_parts").isNull(), F.col(text)).otherwise(F.transform(F.array(gaps), join)[0])
    columns = [F.col("__pw_new").alias(c) if c == text else found[c] for c in docs.columns]
    return found.withColumn("__pw_new", moved).select(*columns, F.flatten("__pw_parts").alias("__pw_found"))


def without_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The columns of docs, with pseudonyms in the text."""
    return pseudonymized(docs, key, text).select(*docs.columns)
