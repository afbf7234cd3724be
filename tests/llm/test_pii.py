import hashlib
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from barloom.llm.pii import KINDS, ROUNDS, private_digest, pseudonymise


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        t += d - 9 * (d > 9)
    return t % 10 == 0


def run(docs, *texts, key="test key"):
    return [r for r in private_digest(docs(list(texts)), key).orderBy("doc_id").collect()]


def test_formats_survive(docs):
    card, phone, ip, day, ssn, mail = run(
        docs, "pay 4944339490429605 or 4111-1111-1111-1111 now", "call +1 (755) 555-9729.", "from 10.20.30.40 on", "born 1999-02-28, 31.12.2001 and 02/29/2000", "ssn 123-45-6789", "to joe.Bloggs+x9@mail6.example.com!"
    )
    a, b = re.fullmatch(r"pay (\d{16}) or ([\d-]{19}) now", card.text).groups()
    assert luhn(a) and luhn(b.replace("-", "")) and a != "4944339490429605" and a[0] == "4" and card.n_card == 2
    assert re.fullmatch(r"call \+1 \(7\d\d\) 5\d\d-\d{4}\.", phone.text) and "555-9729" not in phone.text
    assert all(int(x) < 256 for x in ip.text.split()[1].split(".")) and ip.n_ip == 1
    m = re.fullmatch(r"born (\d{4})-(\d\d)-(\d\d), (\d\d)\.(\d\d)\.(\d{4}) and (\d\d)/(\d\d)/(\d{4})", day.text)
    y = list(map(int, m.groups()))
    assert date(y[0], y[1], y[2]) and date(y[5], y[4], y[3]) and date(y[8], y[6], y[7]) and day.n_date == 3
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", ssn.text) and "6789" not in ssn.text
    assert re.fullmatch(r"to [a-z]{3}\.[A-Z][a-z]{5}\+[a-z]\d@mail6\.example\.com!", mail.text)


def test_invalid_values_stay(docs):
    for t in ("4944339490429606", "000-12-3456 666-12-3456 900-12-3456", "256.1.1.1 1.2.3.4.5", "1999-02-30 2024-13-01", "version 2.0 of 1234", "a@b"):
        r = run(docs, t)[0]
        assert r.text == t and r.n_private == 0


def test_linked_and_keyed(docs):
    a, b, c = run(docs, "x 4944339490429605 y", "4944339490429605", "4944 3394 9042 9605")
    x = a.text.split()[1]
    assert b.text == x and c.text.replace(" ", "") == x
    assert run(docs, "4944339490429605", key="other")[0].text != x


def test_permutations_are_one_to_one(docs):
    days = [f"{d:%Y-%m-%d}" for d in (date.fromordinal(date(1999, 1, 1).toordinal() + k) for k in range(400))]
    out = run(docs, " ".join(days))[0]
    assert out.n_date == 400 and len(set(out.text.split())) == 400
    ssns = [f"{a:03d}-01-0001" for a in range(1, 900) if a != 666]
    out = run(docs, " ".join(ssns))[0].text.split()
    assert len(set(out)) == 898 and not any(s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" for s in out)
    ips = [f"10.0.{k}.{k}" for k in range(256)]
    assert len(set(run(docs, " ".join(ips))[0].text.split())) == 256
    mails = [f"u{k:03d}@x.org" for k in range(300)]
    assert len(set(run(docs, " ".join(mails))[0].text.split())) == 300


def test_odd(odd, docs):
    odd = odd.withColumns({"values": F.lit("mine"), "kinds": F.lit("mine"), "n_email": F.lit("mine")})
    out = pseudonymise(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and "n_email_" in out.columns and out.count() == 9
    assert {(r["values"], r["kinds"], r.n_email, r["__m"]) for r in out.collect()} == {("mine", "mine", "mine", "clash")}
    rows = {r.doc_id: r for r in private_digest(odd).collect()}
    assert rows[1].text is None and rows[2].text == "" and all(rows[1][f"n_{k}"] == 0 for k in KINDS)
    assert private_digest(docs([])).collect() == []


# ---- the same permutations over Python's integers and strings


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def numbers(kind, left, right, n_left, n_right, key="test key"):
    for r in range(1, ROUNDS + 1):
        if r % 2:
            left = (left + int(sha(key, kind, r, right, key)[:15], 16)) % n_left
        else:
            right = (right + int(sha(key, kind, r, left, key)[:15], 16)) % n_right
    return left, right


def digits(kind, d):
    a = len(d) // 2
    left, right = numbers(kind, int(d[:a]), int(d[a:]), 10**a, 10 ** (len(d) - a))
    return f"{left:0{a}d}{right:0{len(d) - a}d}"


def letters(kind, text, key="test key"):
    def shift(half, r, other):
        stream = "".join(sha(key, kind, r, other, key, j) for j in range((len(half) + 31) // 32))
        out = ""
        for i, c in enumerate(half):
            base, n = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26)
            out += chr(base + (ord(c) - base + int(stream[2 * i : 2 * i + 2], 16)) % n) if c.isalnum() else c
        return out

    a = len(text) // 2
    left, right = text[:a], text[a:]
    for r in range(1, ROUNDS + 1):
        if r % 2:
            left = shift(left, r, right)
        else:
            right = shift(right, r, left)
    return left + right


def luhn_of(body):
    return next(c for c in "0123456789" if luhn(body + c))


def test_against_brute_force(docs):
    local, token = "Jane.d-oe_7" * 9, "Ab9_z/" * 40
    day = date(1900, 3, 1) + timedelta(sum(x * y for x, y in zip(numbers("date", *divmod((date(1987, 6, 5) - date(1900, 3, 1)).days, 270), 270, 270), (270, 1))))
    ip = [x for half in numbers("ip", 10 * 256 + 1, 2 * 256 + 3, 65536, 65536) for x in divmod(half, 256)]
    area, rest = numbers("ssn", 700 - 2, 44 * 9999 + 1233, 898, 99 * 9999)
    ten = digits("phone", "55559729")
    north = f"7{ten[:2]}", f"5{ten[2:4]}", ten[4:]
    world = digits("phone", "2079460958")
    body = "4" + digits("card", "94433949042960")
    got = [r.text for r in run(docs, f"{local}@x.org", f"PASSWORD: {token}", "api_key=ab12cd34", "1987/06/05", "10.1.2.3", "700-45-1234", "(755) 555-9729 755 555 9729 +17555559729", "+44 20 7946 0958 or +442079460958", "4944339490429605")]
    assert got == [
        f"{letters('email', local)}@x.org", f"PASSWORD: {letters('secret', token)}", f"api_key={letters('secret', 'ab12cd34')}", f"{day:%Y/%m/%d}", ".".join(map(str, ip)),
        f"{area + (2 if area >= 665 else 1):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}", f"({north[0]}) {north[1]}-{north[2]} {' '.join(north)} +1{''.join(north)}",
        f"+44 {world[:2]} {world[2:6]} {world[6:]} or +44{world}", body + luhn_of(body),
    ]


def test_small_domains_map_onto_themselves(docs):
    mails = [f"{a}{d}@q.org" for a in "abcdefghijklmnopqrstuvwxyz" for d in range(10)]  # hexadecimal and other texts alike
    phones = [f"+1755555{k:04d}" for k in range(0, 10_000, 7)]
    spaced = [f"755 555 {k:04d}" for k in range(0, 10_000, 7)]
    m, p, s = run(docs, " ".join(mails), " ".join(phones), "; ".join(spaced))
    assert sorted(m.text.split()) == sorted(mails) and m.n_email == 260
    assert len(set(p.text.split())) == len(phones) == p.n_phone and [x[2:] for x in p.text.split()] == [x.replace(" ", "") for x in s.text.split("; ")]


def test_no_number_of_the_plan(docs):
    for t in ("+11555559729", "+17551559729", "1 055 555 9729"):
        assert run(docs, t)[0].text == t


def test_case_and_length(docs):
    long = "x9" * 500
    rows = run(docs, f"PASSWORD={long}", f"Token: {long}", f"{long}@a.org", f'Secret = "{long}"')
    assert [r.n_private for r in rows] == [1] * 4 and not any(long in r.text for r in rows)
    assert rows[0].text.split("=")[1] == rows[1].text.split(": ")[1] == rows[3].text.split('"')[1]
