"""The whole of op4 once more in plain Python: finding, checking and permuting, one text at a time."""

import calendar
import hashlib
import re
from datetime import date, timedelta

from procweave.llm import pii, queries

KEY = queries.PII_KEY
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def permuted(value, use):
    half = len(value) // 2
    left, right = value[:half], value[half:]
    for turn in range(1, 9):
        seed, out = digest(KEY, use, turn, right), ""
        for i, c in enumerate(left):
            by = int(digest(seed, i // 16)[i % 16 * 4 :][:4], 16)
            own = "0123456789abcdef" if use == "hex" and c in "0123456789abcdef" else next((a for a in CLASSES if c in a), None)
            out += own[(own.index(c) + by) % len(own)] if own else c
        left, right = right, out
    return left + right


def in_place(value, plain, moved):
    moved = iter(moved)
    return "".join(next(moved) if c in "0123456789" or plain != "digits" and c.isalnum() else c for c in value)


def digits(v):
    return re.sub("[^0-9]", "", v)


def moved_digits(v, use):
    return in_place(v, "digits", permuted(digits(v), use))


def luhn(v):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits(v)))) % 10 == 0


def luhn_digit(body):
    return next(c for c in "0123456789" if luhn(body + c))


def day_of(v):
    a, mark, b, _, c = re.fullmatch(r"(\d+)([/.-])(\d+)([/.-])(\d+)", v).groups()
    if len(a) == 4:
        ways = [("Y", a, b, c)]
    else:
        ways = [("D", c, b, a), ("M", c, a, b)] if mark == "." else [("M", c, a, b), ("D", c, b, a)]
    for order, y, m, d in ways:
        if 1 <= int(m) <= 12 and 1 <= int(d) <= calendar.monthrange(int(y), int(m))[1]:
            return date(int(y), int(m), int(d)), (order, mark, 1 if min(len(a), len(b)) == 1 else 2)
    return None


def written(day, form):
    order, mark, width = form
    y, m, d = f"{day.year:04}", f"{day.month:0{width}}", f"{day.day:0{width}}"
    return mark.join({"Y": (y, m, d), "M": (m, d, y), "D": (d, m, y)}[order])


def moved_date(v):
    day, form = day_of(v)
    first = date(1800, 1, 1)
    while True:
        n = (day - first).days
        left, right = n % 189, n // 189
        for turn in range(1, 9):
            left, right = right, (left + int(digest(KEY, "date", turn, right)[:12], 16)) % (189 if turn % 2 else 773)
        day = first + timedelta(right * 189 + left)
        if day_of(written(day, form))[1] == form:
            return written(day, form)


def moved_ip(v):
    a, b, c, d = map(int, v.split("."))
    left, right = a * 256 + b, c * 256 + d
    for turn in range(1, 9):
        left, right = right, left ^ int(digest(KEY, "ip", turn, right)[:4], 16)
    return ".".join(map(str, (*divmod(left, 256), *divmod(right, 256))))


def mod97(v):
    return int("".join(str(int(c, 36)) for c in v)) % 97


def is_iban(v):
    v = v.replace(" ", "")
    return 15 <= len(v) <= 34 and "02" <= v[2:4] <= "98" and mod97(v[4:] + v[:4]) == 1


def moved_iban(v):
    plain = v.replace(" ", "")
    body = permuted(plain[4:], "iban")
    return in_place(v, "all", plain[:2] + f"{98 - mod97(body + plain[:2] + '00'):02}" + body)


def until(v, step, fine):
    v = step(v)
    while not fine(v):
        v = step(v)
    return v


def email(v):
    name, domain = v.split("@")
    host, top = domain.rsplit(".", 1)
    return f"{permuted(name, 'name')}@{permuted(host, 'host')}.{top}"


def secret(v):
    start, rest = re.fullmatch(r"(?is)(\w+?-?\w*\s*[=:]\s*[\"']?)(.*)", v).groups()
    return start + permuted(rest, "hex" if re.fullmatch("[0-9a-f]+", rest) else "secret")


def phone(v):
    start = re.match(r"(\+[0-9]{1,3}[ .(-]+|\+[0-9]|1[.-])?", v).group()
    rest, plain = v[len(start) :], r"[2-9]\d\d([.-])[2-9]\d\d\1\d{4}"
    return start + (until(rest, lambda x: moved_digits(x, "phone"), lambda x: re.fullmatch(plain, x)) if re.fullmatch(plain, rest) else moved_digits(rest, "phone"))


def ssn_ok(v):
    a, b, c = v.split("-")
    return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"


def card(v):
    body = permuted(digits(v)[:-1], "card")
    return in_place(v, "digits", body + luhn_digit(body))


FINDERS = [
    ("email", r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}", lambda v: True, email),
    ("secret", r"(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key)\b\s*[=:]\s*[\"']?)[A-Za-z0-9_/+-]{8,}", lambda v: True, secret),
    ("access_key", r"\bA[KS]IA[A-Z0-9]{16}\b", lambda v: True, lambda v: v[:4] + permuted(v[4:], "access")),
    ("iban", r"\b[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)\b", is_iban, moved_iban),
    ("date", r"\b(?:1[89]|2[01])\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:\b|(?=T\d))|(?<![\w/.-])[0-3]?\d([/.-])[0-3]?\d\1(?:1[89]|2[01])\d\d(?![\w/-]|\.\d)", day_of, moved_date),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", lambda v: all(int(x) < 256 and str(int(x)) == x for x in v.split(".")), moved_ip),
    ("phone", r"(?<!\w)\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])(?:1[.-])?[2-9]\d\d([.-])[2-9]\d\d\1\d{4}(?![\w-]|\.\d)", lambda v: 8 <= len(digits(v)) <= 15, phone),
    ("ssn", r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])", ssn_ok, lambda v: until(v, lambda x: moved_digits(x, "ssn"), ssn_ok)),
    ("card", r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])", luhn, card),
]
FINDERS = [(name, re.compile(pattern, re.ASCII), fine, move) for name, pattern, fine, move in FINDERS]


def brute(text):
    """The text with pseudonyms, and how many values of each kind; runs of digits with more than a card aren't known here."""
    out, at, counts = "", 0, dict.fromkeys((f[0] for f in FINDERS), 0)
    while found := min(((m.start(), k, m) for k, f in enumerate(FINDERS) if (m := f[1].search(text, at))), key=lambda x: x[:2], default=None):
        start, k, m = found
        name, _, fine, move = FINDERS[k]
        out += text[at:start]
        counts[name] += bool(fine(m.group()))
        out += move(m.group()) if fine(m.group()) else m.group()
        at = m.end()
    return out + text[at:], counts


PLANTED = [
    "born 06/12/2024, 12.06.2024, 31/01/1999, 3/14/1985, 25.12.1999 and 02-30-2000", "at 1985-03-14T10:00:00Z or 2024-02-29", "call 212-555-0134, 1-212-555-0134 or 312.555.0134 now",
    "DE89 3704 0044 0532 0130 00 and GB29NWBK60161331926819, not GB29NWBK60161331926818", "078-05-1120 or 000-12-3456", "ip 10.0.0.1, 010.0.0.1, 300.1.1.1", "+49 30 123456 and (212) 555-1234",
    "joe@example.com.123 a.b@c.d.org- x@y", "pwd: Abc-12345678/x", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "é😀 bob.smith@mail7.example.com é",
]


def test_the_query_over_whole_tables(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_000_000 + k, t) for k, t in enumerate([*PLANTED, None, ""])], "doc_id long, text string")
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.unionByName(more).collect()}
    rows = queries.op4_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    changed = 0
    for r in rows:
        text, counts = brute(texts[r["doc_id"]]) if texts[r["doc_id"]] else (texts[r["doc_id"]], {})
        assert r["text"] == text, texts[r["doc_id"]]
        assert all(r[f"n_{k.name}"] == counts.get(k.name, 0) for k in pii.KINDS), texts[r["doc_id"]]
        changed += text != texts[r["doc_id"]]
    assert changed >= len(PLANTED)


def test_hostile_texts(spark):
    """Very long values of every kind: neither a stack nor time that grows faster than the text."""
    texts = [
        "x@" + "a." * 3000 + "com", "x@" + "ab." * 20_000 + "com", "a." * 100_000 + "@b.com", "x@" + "a" * 200_000 + ".com", "x@" * 100_000, "token=" + "abcdef01" * 25_000, "7" * 200_000,
        "4111 1111 1111 1111 " * 10_000, "0 " * 100_000, "+1 " * 60_000, "(212) " * 30_000, "1.1." * 50_000, "12-" * 60_000, "1/2/" * 50_000, "DE89 " + "3704 " * 40_000, "A" * 200_000, "token " * 30_000, "1985-" * 40_000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    out = {r["doc_id"]: r["text"] for r in pii.without_pii(docs, "k").collect()}
    assert len(out) == len(texts) and all(len(out[k]) == len(t) for k, t in enumerate(texts))
    assert out[5] != texts[5] and "4111 1111 1111 1111" not in out[7] and all(luhn(out[7][k : k + 19]) for k in range(0, 2000, 20))


def test_numbers_stay_valid(spark):
    ssns = [f"{a:03}-{b:02}-{c:04}" for a in (1, 665, 667, 899) for b in (1, 50, 99) for c in range(1, 9999, 77)]
    docs = spark.createDataFrame([(" ".join(ssns[k : k + 300]),) for k in range(0, len(ssns), 300)], "text string")
    out = " ".join(r["text"] for r in pii.without_pii(docs, "k").collect()).split()
    assert len(set(out)) == len(set(ssns)) and all(map(ssn_ok, out))
    days = [written(date(1990, 1, 1) + timedelta(k), f) for k in range(400) for f in (("M", "/", 2), ("D", ".", 2), ("M", "-", 1))]
    docs = spark.createDataFrame([(", ".join(days[k : k + 200]),) for k in range(0, len(days), 200)], "text string")
    out = ", ".join(r["text"] for r in pii.without_pii(docs, "k").collect()).split(", ")
    assert len(set(out)) == len(set(days)) and all(day_of(a)[1] == day_of(b)[1] for a, b in zip(days, out, strict=True))
