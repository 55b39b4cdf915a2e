"""Operator 5: format-preserving Feistel pseudonyms, in Spark SQL functions only.

One pattern finds candidates; each is validated (Luhn, mod 97, calendar, ranges) and its number is
permuted inside its own format by a keyed Feistel network over Z_a x Z_b: halves are added to the other
half's keyed hash modulo a and b in turn, which is a permutation of 0 .. a*b-1. The same value and key give
the same pseudonym in every document, so records stay linked, and the key holder can invert it.

| kind | domain that is permuted | kept |
|-|-|-|
| card | digits between the first and the check digit | first digit; a new valid Luhn digit |
| IBAN | digits of the account part | country, letters; new valid check digits |
| phone | digits but country code and the first of area and exchange | layout |
| SSN | group 1-99 and serial 1-9999 | area |
| IPv4 | lower three octets | first octet |
| date | the 146,097 days of 1800-01-01 to 2199-12-31 | order, separators, padding |
| e-mail | letters and digits of the local part (lower-cased) | layout, domain |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import table

#: Spark setting that holds the key; Spark hides settings of this kind of name from its logs and pages.
KEY_SETTING = "spark.folioscope.pseudonymSecret"
#: A public key, for tables without secrets: anyone can invert its pseudonyms. It is used by whoever asks for it by this name only.
DEMO = "demo-key-for-synthetic-tables"
#: SQL name of the key inside the expressions.
KEY = "pseudonym_key"
ROUNDS = 10

#: Fixed patterns, in order of preference at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "iso": r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|-[0-9])",
    "dmy": r"(?<![0-9A-Za-z./])[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}(?![0-9A-Za-z]|[./][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "nanp": r"(?<![0-9A-Za-z])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(x: str, a: str, b: str, tweak: str, key: str) -> str:
    """SQL: the keyed permutation of 0 <= x < a*b."""
    hashed = lambda half: f"cast(conv(substr(sha2(concat_ws('|', {key}, {tweak}, fi, {half}), 256), 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', ({x}) div ({b}), 'r', ({x}) % ({b})), (fs, fi) -> if(fi % 2 = 0, "
        f"named_struct('l', (fs.l + {hashed('fs.r')}) % ({a}), 'r', fs.r), named_struct('l', fs.l, 'r', (fs.r + {hashed('fs.l')}) % ({b}))), fs -> fs.l * ({b}) + fs.r)"
    )


def _power(base: int, n: str) -> str:
    return f"cast(pow({base}, {n}) as bigint)"


def digits(d: str, tweak: str, key: str) -> str:
    """SQL: permuted digit string of up to 18 digits, its length kept."""
    n = f"length({d})"
    done = feistel(f"cast({d} as bigint)", _power(10, f"{n} div 2"), _power(10, f"{n} - {n} div 2"), f"concat({tweak}, {n})", key)
    return f"if({n} = 0, '', lpad(cast({done} as string), {n}, '0'))"


def letters(s: str, tweak: str, key: str) -> str:
    """SQL: permuted string of a-z, in runs of up to 12 letters."""
    az, base26 = "'abcdefghijklmnopqrstuvwxyz'", "'0123456789abcdefghijklmnop'"
    n = "length(run)"
    done = feistel(f"cast(conv(translate(run, {az}, {base26}), 26, 10) as bigint)", _power(26, f"{n} div 2"), _power(26, f"{n} - {n} div 2"), f"concat({tweak}, {n})", key)
    back = f"lpad(translate(lower(conv(cast({done} as string), 10, 26)), {base26}, {az}), {n}, 'a')"
    return f"array_join(transform(regexp_extract_all({s}, '.{{1,12}}', 0), run -> {back}), '')"


def _only(s: str, keep: str) -> str:
    return f"regexp_replace({s}, '[^{keep}]', '')"


def _laid(s: str, keep: str, new: str) -> str:
    """SQL: s with its characters of the class replaced in order by those of new."""
    at = f"length({_only(f'substr({s}, 1, li)', keep)})"
    return f"array_join(transform(sequence(1, length({s})), li -> if(substr({s}, li, 1) rlike '[{keep}]', substr({new}, {at}, 1), substr({s}, li, 1))), '')"


def _luhn(d: str, doubled: int) -> str:
    """SQL: Luhn sum of digit string d; doubled is the parity (from the right, counting from 1) of the doubled places."""
    digit = f"cast(substr({d}, -ci, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (cs, ci) -> cs + if(ci % 2 = {doubled}, {digit} * 2 - if({digit} > 4, 9, 0), {digit}))"


def _mod97(s: str) -> str:
    char = "substr(mt, mi, 1)"
    value = f"if({char} rlike '[0-9]', cast(ascii({char}) as int) - 48, ascii({char}) - 55)"
    return f"element_at(transform(array({s}), mt -> aggregate(sequence(1, length(mt)), 0, (ms, mi) -> (ms * if({char} rlike '[0-9]', 10, 100) + {value}) % 97)), 1)"


def _with(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _card(v: str, key: str) -> str:
    d = _only(v, "0-9")
    payload = f"concat(substr(cd, 1, 1), {digits('substr(cd, 2, length(cd) - 2)', _text('card'), key)})"
    fresh = _with(payload, "cp", f"concat(cp, cast((10 - {_luhn('cp', 1)} % 10) % 10 as string))")
    return _with(d, "cd", f"if(length(cd) between 13 and 19 and {_luhn('cd', 0)} % 10 = 0, {_with(fresh, 'cn', _laid(v, '0-9', 'cn'))}, {v})")


def _iban(v: str, key: str) -> str:
    valid = f"length(ib) between 15 and 34 and {_mod97('concat(substr(ib, 5), substr(ib, 1, 4))')} = 1"
    own = _only("substr(ib, 5)", "0-9")
    new = f"concat({digits('substr(id, 1, 15)', _text('iban'), key)}, {digits('substr(id, 16)', _text('iban2'), key)})"
    account = _with(own, "id", _with(new, "ie", _laid("substr(ib, 5)", "0-9", "ie")))
    check = f"lpad(cast(98 - {_mod97(chr(39).join(['concat(ia, substr(ib, 1, 2), ', '00', ')']))} as string), 2, '0')"
    whole = _with(account, "ia", f"concat(substr(ib, 1, 2), {check}, ia)")
    return _with(f"regexp_replace({v}, ' ', '')", "ib", f"if({valid}, {_with(whole, 'iw', _laid(v, 'A-Z0-9', 'iw'))}, {v})")


def _ssn(v: str, key: str) -> str:
    area, group, serial = f"cast(substr({v}, 1, 3) as bigint)", f"cast(substr({v}, 5, 2) as bigint)", f"cast(substr({v}, 8, 4) as bigint)"
    done = feistel(f"({group} - 1) * 9999 + {serial} - 1", "99L", "9999L", _text("ssn"), key)
    fresh = _with(done, "sn", f"concat(substr({v}, 1, 4), lpad(cast(sn div 9999 + 1 as string), 2, '0'), '-', lpad(cast(sn % 9999 + 1 as string), 4, '0'))")
    return f"if({area} not in (0, 666) and {area} < 900 and {group} > 0 and {serial} > 0, {fresh}, {v})"


def _ip(v: str, key: str) -> str:
    octet = lambda i: f"cast(split({v}, '[.]')[{i}] as bigint)"
    done = feistel(f"({octet(1)} * 256 + {octet(2)}) * 256 + {octet(3)}", "4096L", "4096L", _text("ip"), key)
    fresh = _with(done, "pn", f"concat_ws('.', split({v}, '[.]')[0], pn div 65536, (pn div 256) % 256, pn % 256)")
    return f"if(forall(split({v}, '[.]'), o -> cast(o as int) <= 255), {fresh}, {v})"


def _nanp(v: str, key: str) -> str:
    d = f"right({_only(v, '0-9')}, 10)"
    moved = digits("concat(substr(nd, 2, 2), substr(nd, 5))", _text("phone"), key)
    new = _with(moved, "nm", "concat(if(length(nx) > 10, left(nx, length(nx) - 10), ''), substr(nd, 1, 1), substr(nm, 1, 2), substr(nd, 4, 1), substr(nm, 3))")
    return _with(_only(v, "0-9"), "nx", _with(d, "nd", _with(new, "nn", _laid(v, "0-9", "nn"))))


def _phone(v: str, key: str) -> str:
    moved = digits("substr(qd, 4)", _text("phone"), key)
    return _with(_only(v, "0-9"), "qd", f"if(length(qd) between 8 and 15, {_with(f'concat(substr(qd, 1, 3), {moved})', 'qn', _laid(v, '0-9', 'qn'))}, {v})")


def _days(y: str, m: str, d: str) -> str:
    """SQL: days since 1800-01-01 of a valid date of those 400 years, else null."""
    first = f"make_date({y}, {m}, 1)"
    return f"if({y} between 1800 and 2199 and {m} between 1 and 12, if({d} between 1 and day(last_day({first})), datediff({first}, date'1800-01-01') + {d} - 1, null), null)"


def _moved(days: str, key: str) -> str:
    return f"date_add(date'1800-01-01', cast({feistel(f'cast({days} as bigint)', '189L', '773L', _text('date'), key)} as int))"


def _iso(v: str, key: str) -> str:
    part = lambda i: f"cast(split({v}, '-')[{i}] as int)"
    return _with(_days(part(0), part(1), part(2)), "di", f"if(di is null, {v}, date_format({_moved('di', key)}, 'yyyy-MM-dd'))")


def _dmy(v: str, key: str) -> str:
    sep = f"regexp_extract({v}, '[./]', 0)"
    part = lambda i: f"cast(split({v}, '[./]')[{i}] as int)"
    day, month = _days(part(2), part(1), part(0)), _days(part(2), part(0), part(1))
    width = lambda i, of: f"if(length(split({v}, '[./]')[{i}]) = 2, lpad(cast({of}(dm) as string), 2, '0'), cast({of}(dm) as string))"
    made = lambda first, second: f"concat({width(0, first)}, {sep}, {width(1, second)}, {sep}, cast(year(dm) as string))"
    return _with(day, "dd", _with(month, "de", f"if(dd is null and de is null, {v}, {_with(_moved('coalesce(dd, de)', key), 'dm', f'if(dd is not null, {made('day', 'month')}, {made('month', 'day')})')})"))


def _email(v: str, key: str) -> str:
    local = f"lower(substring_index({v}, '@', 1))"
    named = _with(letters(_only("el", "a-z"), _text("mail"), key), "en", _laid("el", "a-z", "en"))
    numbers = f"array_join(transform(regexp_extract_all({_only('em', '0-9')}, '.{{1,16}}', 0), er -> {digits('er', _text('mail'), key)}), '')"
    whole = _with(named, "em", _with(numbers, "ed", _laid("em", "0-9", "ed")))
    return _with(local, "el", f"concat({whole}, '@', substr({v}, length(el) + 2))")


RULES = {"email": _email, "iban": _iban, "iso": _iso, "dmy": _dmy, "ssn": _ssn, "ip": _ip, "nanp": _nanp, "phone": _phone, "card": _card}


def pseudonym(v: str, key: str = KEY) -> str:
    """SQL: the pseudonym of candidate v by its kind; v itself if it is not valid."""
    rules = " ".join(f"when {v} rlike {_text('^(?:' + PATTERNS[k].replace(chr(92) + '2', chr(92) + '1').replace(chr(92) + '3', chr(92) + '2') + ')$')} then {rule(v, key)}" for k, rule in RULES.items())
    return f"case {rules} else {v} end"


def session_key(spark: SparkSession, unset: str | None = None) -> str:
    """The key that the session names. Without one: `unset`, which only callers over tables without secrets give, else an error."""
    key = spark.conf.get(KEY_SETTING, None) or unset
    if not key:
        raise ValueError(f"pseudonyms need a secret key: set {KEY_SETTING}")
    return key


def masked(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the personal numbers, dates and addresses of text_col replaced by pseudonyms under the secret key.

    Every other column, whatever its name, and every other character stays. A null text stays null, an empty one
    empty; invalid candidates (a failing check digit, 30 February) stay. count_col: a new column with
    the number of replaced values. Narrow: rows are not moved, repeated ones stay, an empty table stays empty. The key
    reaches the tasks as data and stands in no plan.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    if count_col and count_col in docs.columns:
        raise ValueError(f"column {count_col} exists")
    names = list(docs.columns)
    mark = "p" + "_" * max(map(len, names))  # longer than any column's name
    held, found_col, new_col = f"{mark}_held", f"{mark}_found", f"{mark}_new"
    secret = docs.sparkSession.createDataFrame([(key,)], "secret string").scalar()
    text = f"{held}.`{text_col}`"
    # groups of one pattern are numbered through the whole alternation
    found = F.when(F.col(text).rlike("[0-9@]"), F.expr(f"regexp_extract_all({text}, {_text(ANY)}, 0)"))
    step = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias(held), secret.alias(KEY))
    step = step.withColumn(found_col, F.coalesce(found, F.array().cast("array<string>")))
    step = step.withColumn(new_col, F.expr(f"transform({found_col}, v -> {pseudonym('v')})"))
    gaps = F.expr(f"split({text}, {_text(ANY)}, -1)")
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new_col, i), F.lit("")))), "")
    out = [(F.when(F.size(found_col) > 0, joined).otherwise(F.col(text)) if c == text_col else F.col(f"{held}.`{c}`")).alias(c) for c in names]
    if count_col:
        out.append(F.size(F.filter(F.arrays_zip(found_col, new_col), lambda p: p[found_col] != p[new_col])).alias(count_col))
    return step.select(*out)


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return masked(docs, session_key(spark, unset=DEMO), count_col="n_pseudonyms")  # the test tables hold no secrets


QUERIES = {"op5_pii_pseudonyms": op5_pii_pseudonyms}
ORACLE: dict[str, str] = {}
