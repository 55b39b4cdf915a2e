import re
from datetime import date, timedelta
from hashlib import sha256

import pytest

from folioscope.llm import pii as P


def hashed(key, tweak, i, half):
    return int(sha256(f"{key}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)


KEY = "test key"


def slow_feistel(x, a, b, tweak, key=KEY):
    left, right = divmod(x, b)
    for i in range(10):
        if i % 2 == 0:
            left = (left + hashed(key, tweak, i, right)) % a
        else:
            right = (right + hashed(key, tweak, i, left)) % b
    return left * b + right


def slow_digits(d, tweak):
    n = len(d)
    return str(slow_feistel(int(d), 10 ** (n // 2), 10 ** (n - n // 2), f"{tweak}{n}")).zfill(n) if n else ""


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def one(spark, text):
    return P.masked(spark.createDataFrame([(text,)], "text string"), KEY, count_col="n").collect()[0]


def slow_runs(s, width, one):
    return "".join(one(s[i : i + width]) for i in range(0, len(s), width))


def slow_letters(run):
    value = 0
    for c in run:
        value = value * 26 + ord(c) - 97
    n = len(run)
    value = slow_feistel(value, 26 ** (n // 2), 26 ** (n - n // 2), f"mail{n}")
    out = ""
    for _ in range(n):
        value, r = divmod(value, 26)
        out = chr(97 + r) + out
    return out


def laid(s, keep, new):
    it = iter(new)
    return "".join(next(it) if re.match(f"[{keep}]", c) else c for c in s)


def luhn_digit(payload):
    return next(d for d in "0123456789" if luhn(payload + d))


def slow_day(d):
    return date(1800, 1, 1) + timedelta(slow_feistel((d - date(1800, 1, 1)).days, 189, 773, "date"))


def day_of(y, m, d):
    try:
        return date(y, m, d) if 1800 <= y < 2200 else None
    except ValueError:
        return None


def slow_value(v):
    """The pseudonym of one candidate by plain arithmetic, kind by kind."""
    kind = next(k for k, p in P.PATTERNS.items() if re.fullmatch(p.replace("\\2", "\\1").replace("\\3", "\\2"), v))
    d = re.sub("[^0-9]", "", v)
    if kind == "email":
        local, rest = v.split("@", 1)
        local = "".join(c.lower() if c.isascii() else c for c in local)
        local = laid(local, "a-z", slow_runs(re.sub("[^a-z]", "", local), 12, slow_letters))
        return laid(local, "0-9", slow_runs(re.sub("[^0-9]", "", local), 16, lambda r: slow_digits(r, "mail"))) + "@" + rest
    if kind == "iban":
        own = v.replace(" ", "")
        if not 15 <= len(own) <= 34 or mod97(own) != 1:
            return v
        account = re.sub("[^0-9]", "", own[4:])
        account = laid(own[4:], "0-9", slow_digits(account[:15], "iban") + slow_digits(account[15:], "iban2"))
        check = 98 - mod97(own[:2] + "00" + account)
        return laid(v, "A-Z0-9", f"{own[:2]}{check:02d}{account}")
    if kind == "iso":
        day = day_of(*map(int, v.split("-")))
        return f"{slow_day(day)}" if day else v
    if kind == "dmy":
        sep = re.search("[./]", v)[0]
        a, b, y = v.split(sep)
        day, swapped = day_of(int(y), int(b), int(a)), day_of(int(y), int(a), int(b))
        if not (day or swapped):
            return v
        new = slow_day(day or swapped)
        first, second = (new.day, new.month) if day else (new.month, new.day)
        return sep.join([f"{first:02d}" if len(a) == 2 else str(first), f"{second:02d}" if len(b) == 2 else str(second), f"{new.year}"])
    if kind == "ssn":
        area, group, serial = map(int, v.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return v
        x = slow_feistel((group - 1) * 9999 + serial - 1, 99, 9999, "ssn")
        return f"{v[:4]}{x // 9999 + 1:02d}-{x % 9999 + 1:04d}"
    if kind == "ip":
        o = [int(x) for x in v.split(".")]
        if max(o) > 255:
            return v
        x = slow_feistel((o[1] * 256 + o[2]) * 256 + o[3], 4096, 4096, "ip")
        return f"{v.split('.')[0]}.{x >> 16}.{x >> 8 & 255}.{x & 255}"
    if kind == "nanp":
        own = d[-10:]
        moved = slow_digits(own[1:3] + own[4:], "phone")
        return laid(v, "0-9", d[:-10] + own[0] + moved[:2] + own[3] + moved[2:])
    if kind == "phone":
        return laid(v, "0-9", d[:3] + slow_digits(d[3:], "phone")) if 8 <= len(d) <= 15 else v
    if not luhn(d):
        return v
    payload = d[0] + slow_digits(d[1:-1], "card")
    return laid(v, "0-9", payload + luhn_digit(payload))


def slow_masked(text):
    return re.sub(P.ANY, lambda m: slow_value(m[0]), text) if text else text


def test_whole_texts_match_the_plain_model(spark):
    """Every kind, valid and not, in the tables' documents and in texts of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [
        "mail A.b-9c@x-y.example.org, LONGERLOCALPARTOFMANYLETTERS12345678901234567890@mail.example.com x@y.z not@mail",
        "DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 FR7630006000011234567890189 NO9386011117947 GB82WEST12345698765433",
        "1999-12-31 2024-02-29 2023-02-29 1799-01-01 31/12/1999 12/31/1999 1.2.2003 01.02.2003 32.1.2000 13/13/2000",
        "123-45-6789 666-45-6789 900-45-6789 001-00-1234 1.2.3.4 255.255.255.255 256.1.1.1 10.000.1.01",
        "(988) 555-2485 +1 389 555 5010 389-555-5010 +44 20 7946 0958 +49 30 123456 +1 2",
        "4337166598464399 4111-1111-1111-1111 4111 1111 1111 1111 378282246310005 3782 822463 10005 4111111111111112 30569309025904",
    ]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*extra, None, "", "é" * 50 + extra[0] * 40])], docs.schema)
    want = {r.doc_id: slow_masked(r.text) for r in docs.union(more).collect()}
    got = {r.doc_id: r.text for r in P.masked(docs.union(more), KEY).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert sum(want[r.doc_id] != r.text for r in docs.collect()) > 5


def test_key_is_needed_and_stands_in_no_plan(spark, capsys):
    df = spark.createDataFrame([("x 4337166598464399",)], "text string")
    with pytest.raises(ValueError):
        P.masked(df, "")
    P.masked(df, "very-secret-key").explain(True)
    assert "very-secret-key" not in capsys.readouterr().out
    with pytest.raises(ValueError, match="pseudonymSecret"):
        P.session_key(spark)
    assert P.session_key(spark, unset=P.DEMO) == P.DEMO
    spark.conf.set(P.KEY_SETTING, "own")
    assert P.session_key(spark, unset=P.DEMO) == P.session_key(spark) == "own"
    spark.conf.unset(P.KEY_SETTING)


def test_columns_of_any_name(spark):
    names = ["text", "p_held", "__found", "__new", "pseudonym_key", "v", "fs"]
    df = spark.createDataFrame([("x 4337166598464399", *"abcdef")], names)
    (row,) = P.masked(df, KEY).collect()
    assert tuple(row)[1:] == tuple("abcdef") and list(row.asDict()) == names and row.text == one(spark, "x 4337166598464399").text


def test_feistel_is_a_permutation(spark):
    rows = spark.range(189 * 11).selectExpr(f"id", f"{P.feistel('id', '189L', '11L', repr('t'), repr(KEY))} AS y").collect()
    assert sorted(r.y for r in rows) == list(range(189 * 11))
    assert all(r.y == slow_feistel(r.id, 189, 11, "t") for r in rows[:300])


def test_kinds(spark):
    text = "Card 4337166598464399, 4111 1111-1111 1111 and 4111-1111-1111-1111. Tel (988) 555-2485 or +1 (389) 555-5010! IP 70.123.182.155. Mail Bosbt.42@mail8.example.com; born 1999-12-31, 31/12/1999, 2.1.1980; SSN 123-45-6789; IBAN DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 +44 20 7946 0958"
    got = one(spark, text)
    new = got.text
    assert len(new) >= len(text) - 12 and got.n == 13
    card = re.search(r"Card (\d{16}),", new)[1]
    body = slow_digits("33716659846439", "card")
    assert card[:15] == "4" + body and luhn(card)
    assert "4111 1111-1111 1111" in new
    assert luhn(re.search(r"and (4\d{3}-\d{4}-\d{4}-\d{4})\.", new)[1].replace("-", ""))
    phone = re.search(r"Tel \((\d{3})\) (\d{3})-(\d{4}) or", new)
    moved = slow_digits("88552485", "phone")
    assert "".join(phone.groups()) == "9" + moved[:2] + "5" + moved[2:]
    assert re.search(r"\+1 \(3\d\d\) 5\d\d-\d{4}!", new)
    ip = slow_feistel((123 * 256 + 182) * 256 + 155, 4096, 4096, "ip")
    assert f"IP 70.{ip >> 16}.{ip >> 8 & 255}.{ip & 255}." in new
    assert re.search(r"Mail [a-z]{5}\.\d\d@mail8\.example\.com;", new) and "osbt.42" not in new
    day = date(1800, 1, 1) + timedelta(slow_feistel((date(1999, 12, 31) - date(1800, 1, 1)).days, 189, 773, "date"))
    assert f"born {day}, {day:%d/%m/%Y}, " in new
    ssn = slow_feistel(44 * 9999 + 6788, 99, 9999, "ssn")
    assert f"SSN 123-{ssn // 9999 + 1:02d}-{ssn % 9999 + 1:04d};" in new
    for iban in re.search(r"IBAN (DE[\d ]+00|DE[\d ]{25}) (GB\d\dWEST\d+)", new).groups():
        assert mod97(iban.replace(" ", "")) == 1
    assert "DE89 3704" not in new and "12345698765432" not in new
    assert re.search(r"\+44 2\d \d{4} \d{4}$", new) and "7946 0958" not in new


def test_invalid_values_stay(spark):
    text = "4337166598464398 999.1.1.1 2023-02-30 32/13/2000 DE88370400440532013000 000-12-3456 version 1.2.3 a4337166598464399 1234567890123 0641917ea4e9feb9cda83477b57ac2654884f485 12-34"
    got = one(spark, text)
    assert got.text == text and got.n == 0


def test_linked_and_keyed(spark):
    df = spark.createDataFrame([(1, "x 4337166598464399", "n1"), (2, "4337166598464399", None), (3, None, None), (4, "", None), (5, "no digits @ all", None), (1, "x 4337166598464399", "n1")], "doc_id long, text string, n string")
    rows = P.masked(df, KEY).collect()
    assert df.columns == P.masked(df, KEY).columns and len(rows) == 6
    assert rows[0].text == "x " + rows[1].text and rows[0] == rows[5]
    assert [r.text for r in rows[2:5]] == [None, "", "no digits @ all"]
    assert P.masked(df, "other").collect()[1].text != rows[1].text
    assert P.masked(df.where("false"), KEY).collect() == []


def test_long_text(spark):
    text = "word 4337166598464399 (988) 555-2485\n" * 5000
    got = one(spark, text)
    assert got.n == 10000 and len(set(got.text.splitlines())) == 1 and got.text.splitlines()[0] != text.splitlines()[0]
