"""PII: format-preserving Feistel pseudonyms, as SQL expressions only.

Values are found by one regular expression and then validated: octets of addresses, calendar dates, check digits of
card numbers and of bank accounts. What fails is no value: it stays as it is and is not counted. Each value
is moved by a keyed permutation of the values of its own format, a Feistel network whose round function is SHA-2,
so equal values have equal pseudonyms in all documents and unlike ones unlike:

- payment cards, 13 to 19 digits with a valid Luhn check digit: all digits but the last, which is made valid again;
- bank accounts (IBAN) with valid check digits: the digits after them, which are then made valid again;
- telephone numbers: all digits after the country code (without one, those that may have any value); social security numbers: all digits;
- IPv4 addresses: 32 bits; IPv6 addresses: all hexadecimal digits, colons staying where they are;
- dates of 1900 to 2099: the day's number, walking the cycle until it is in range. Dates with slashes are read as
  dd/MM/yyyy, and where the calendar lacks that day as MM/dd/yyyy;
- hexadecimal secrets of 32 to 64 digits: both halves, by exclusive or;
- keys of known services (a fixed prefix and letters and digits): the characters after the prefix, by sums modulo
  the alphabet's size, half by half.

E-mail addresses have no fixed format: they get a keyed digest at a reserved domain.
"""

from __future__ import annotations

import secrets

import regex as re
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm._common import unused

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31, within DAYS_A * DAYS_B.
DAYS, DAYS_A, DAYS_B = 73049, 271, 270
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Keys of services: prefix, alphabet's class, length; the prefix stays.
TOKENS = (
    ("(?:AKIA|ASIA)", "[0-9A-Z]", 16, 16),
    ("gh[pousr]_", "[0-9A-Za-z]", 30, 60),
    ("glpat-", "[0-9A-Za-z]", 20, 60),
    ("AIza", "[0-9A-Za-z]", 30, 40),
    ("[rs]k_(?:live|test)_", "[0-9A-Za-z]", 16, 60),
    ("xox[abpr]-", "[0-9A-Za-z]", 10, 60),
)
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PATTERNS = {
    "token": "(?<![0-9A-Za-z_-])(?:" + "|".join(f"{p}{c}{{{a},{b}}}" for p, c, a, b in TOKENS) + ")(?![0-9A-Za-z_-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*\d)(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "email": r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "date": r"(?<![\d.-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d[./]\d\d[./](?:19|20)\d\d)(?![\d-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "local": r"(?<![\w.-])[2-9]\d\d([-. ])[2-9]\d\d\1\d{4}(?![\w-]|\.\d)|(?<![\w.-])0\d{2,4}[ /-]\d{6,8}(?![\w-]|\.\d)",
    "number": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)",
}


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "''") + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _mac(key: str, kind: str, *parts: str) -> str:
    return f"sha2(concat_ws('|', {key}, '{kind}', {', '.join(f'cast({p} as string)' for p in parts)}), 256)"


def _feistel(key: str, kind: str, left: str, right: str, a: str, b: str) -> str:
    """SQL of struct(l, r): the pair (left, right), below (a, b), permuted."""
    step = lambda half: f"cast(conv(substring({_mac(key, kind, a, b, 'i', half)}, 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (z, i) -> if(i % 2 = 0,"
        f" named_struct('l', pmod(z.l + {step('z.r')}, {a}), 'r', z.r), named_struct('l', z.l, 'r', pmod(z.r + {step('z.l')}, {b}))))"
    )


def _digits(key: str, kind: str, d: str) -> str:
    """SQL of a string of two or more digits permuted among those of its length."""
    u = f"cast(ceil(length({d}) / 2) as int)"
    a, b = f"cast(pow(10, {u}) as bigint)", f"cast(pow(10, length({d}) - {u}) as bigint)"
    made = _feistel(key, kind, f"substring({d}, 1, {u})", f"substring({d}, {u} + 1)", a, b)
    return _let("y", made, f"concat(lpad(cast(y.l as string), {u}, '0'), lpad(cast(y.r as string), length({d}) - {u}, '0'))")


def _luhn(d: str) -> str:
    """SQL of the check digit of a string of digits."""
    digit = f"cast(substring({d}, length({d}) - j + 1, 1) as int)"
    total = f"aggregate(sequence(1, length({d})), 0, (s, j) -> s + if(j % 2 = 1, 2 * {digit} - if({digit} > 4, 9, 0), {digit}))"
    return f"pmod(10 - {total}, 10)"


def _filled(value: str, digits: str) -> str:
    """SQL of value with its digits, in order, replaced by those of a string."""
    c = f"substring({value}, j, 1)"
    return (
        f"aggregate(sequence(1, length({value})), named_struct('s', '', 'k', 1), (z, j) -> if({c} rlike '[0-9]',"
        f" named_struct('s', concat(z.s, substring({digits}, z.k, 1)), 'k', z.k + 1), named_struct('s', concat(z.s, {c}), 'k', z.k)), z -> z.s)"
    )


def _number(key: str, v: str) -> str:
    """A number whose last digit is not its Luhn digit is none."""
    body = _let("p", "left(d, length(d) - 1)", f"if({_luhn('p')} = cast(right(d, 1) as int), {_let('m', _digits(key, 'number', 'p'), _let('e', 'concat(m, cast(' + _luhn('m') + ' as string))', _filled(v, 'e')))}, null)")
    return _let("d", f"regexp_replace({v}, '[^0-9]', '')", body)


def _mod97(text: str) -> str:
    """SQL of a string of digits and A-Z, letters read as 10 to 35, modulo 97."""
    c = f"substring({text}, j, 1)"
    return f"aggregate(sequence(1, length({text})), 0, (a, j) -> if({c} rlike '[0-9]', (a * 10 + cast({c} as int)) % 97, (a * 100 + ascii({c}) - 55) % 97))"


def _iban(key: str, v: str) -> str:
    body = _let("m", _chars(key, "iban", "regexp_replace(substring(b, 5), '[^0-9]', '')", _ALNUM[:10]), _let("n", _filled("substring(b, 5)", "m"), _let(
        "k", f"98 - {_mod97('concat(n, left(b, 2), ' + repr('00') + ')')}", "concat(left(b, 2), lpad(cast(k as string), 2, '0'), n)")))
    spaced = "aggregate(sequence(1, length({v})), named_struct('s', '', 'k', 1), (z, i) -> if(substring({v}, i, 1) = ' ', named_struct('s', concat(z.s, ' '), 'k', z.k), named_struct('s', concat(z.s, substring(w, z.k, 1)), 'k', z.k + 1)), z -> z.s)".replace("{v}", v)
    return _let("b", f"replace({v}, ' ', '')", f"if({_mod97('concat(substring(b, 5), left(b, 4))')} = 1 and length(b) between 15 and 34, {_let('w', body, spaced)}, null)")


def _plain(key: str, kind: str, v: str) -> str:
    return _let("d", f"regexp_replace({v}, '[^0-9]', '')", _let("e", _digits(key, kind, "d"), _filled(v, "e")))


def _phone(key: str, v: str) -> str:
    code = f"regexp_extract({v}, '^[+][0-9]{{1,3}}(?=[^0-9])', 0)"
    return _let("c", code, _let("w", f"substring({v}, length(c) + 1)", f"concat(c, {_plain(key, 'phone', 'w')})"))


def _local(key: str, v: str) -> str:
    """A number without country code: a leading 0, or the first digits of area and exchange, which are 2 to 9, stay."""
    national = _let("w", f"substring({v}, 2)", f"concat('0', {_plain(key, 'phone', 'w')})")
    american = _let("w", f"concat(substring({v}, 2, 3), substring({v}, 6))", _let("x", _plain(key, "phone", "w"), f"concat(left({v}, 1), substring(x, 1, 3), substring({v}, 5, 1), substring(x, 4))"))
    return f"if({v} like '0%', {national}, {american})"


def _ip(key: str, v: str) -> str:
    made = _feistel(key, "ip", "cast(o[0] as bigint) * 256 + cast(o[1] as bigint)", "cast(o[2] as bigint) * 256 + cast(o[3] as bigint)", "65536L", "65536L")
    return _let("o", f"split({v}, '[.]')", _let("y", made, "concat_ws('.', y.l div 256, y.l % 256, y.r div 256, y.r % 256)"))


def _ip6(key: str, v: str) -> str:
    c = f"substring({v}, j, 1)"
    filled = f"aggregate(sequence(1, length({v})), named_struct('s', '', 'k', 1), (z, j) -> if({c} = ':', named_struct('s', concat(z.s, ':'), 'k', z.k), named_struct('s', concat(z.s, substring(x, z.k, 1)), 'k', z.k + 1)), z -> z.s)"
    return _let("g", f"lower(replace({v}, ':', ''))", _let("x", _chars(key, "ip6", "g", "0123456789abcdef"), filled))


def _chars(key: str, kind: str, text: str, alphabet: str) -> str:
    """SQL of a string of 2 to 64 characters of an alphabet permuted among those of its length: each half's characters moved by sums that the other half gives."""
    n, letters = len(alphabet), f"'{alphabet}'"

    def moved(half: str, other: str) -> str:
        mac = f"sha2(concat_ws('|', {key}, '{kind}', cast(length(t) as string), cast(i as string), {other}), 512)"
        step = f"substring({letters}, pmod(instr({letters}, substring(q.a, p, 1)) - 1 + cast(conv(substring(q.m, 4 * p - 3, 4), 16, 10) as int), {n}) + 1, 1)"
        return _let("q", f"named_struct('a', {half}, 'm', {mac})", f"array_join(transform(sequence(1, length(q.a)), p -> {step}), '')")

    u = "cast(ceil(length(t) / 2) as int)"
    made = (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substring(t, 1, {u}), 'r', substring(t, {u} + 1)), (z, i) -> if(i % 2 = 0,"
        f" named_struct('l', {moved('z.l', 'z.r')}, 'r', z.r), named_struct('l', z.l, 'r', {moved('z.r', 'z.l')})), z -> concat(z.l, z.r))"
    )
    return _let("t", text, f"if(length(t) < 2, t, {made})")


def _token(key: str, v: str) -> str:
    prefix = "^(" + "|".join(p for p, _, _, _ in TOKENS) + ")"
    made = f"if(t0 rlike '^(AKIA|ASIA)', {_chars(key, 'token', 'substring(' + v + ', length(t0) + 1)', _ALNUM[:36])}, {_chars(key, 'token', 'substring(' + v + ', length(t0) + 1)', _ALNUM)})"
    return _let("t0", f"regexp_extract({v}, '{prefix}', 0)", f"concat(t0, {made})")


def _date(key: str, v: str) -> str:
    """A date that the calendar lacks is none."""
    once = lambda x: _let("f", _feistel(key, "date", f"{x} div {DAYS_B}", f"{x} % {DAYS_B}", f"{DAYS_A}L", f"{DAYS_B}L"), f"f.l * {DAYS_B} + f.r")
    walked = f"aggregate(sequence(1, 16), {once('n')}, (x, k) -> if(x < {DAYS}, x, {once('x')}))"
    moved = lambda fmt: f"date_format(date_add(date'1900-01-01', cast({walked} as int)), '{fmt}')"

    def by(fmt: str, other: str = "null") -> str:
        return _let("n", f"cast(datediff(cast(try_to_timestamp({v}, '{fmt}') as date), date'1900-01-01') as bigint)", f"if(n is null, {other}, {moved(fmt)})")

    return f"case when {v} rlike '^[0-9]{{4}}' then {by('yyyy-MM-dd')} when {v} rlike '^..[.]..[.]' then {by('dd.MM.yyyy')} when {v} rlike '^../../' then {by('dd/MM/yyyy', by('MM/dd/yyyy'))} end"


def _secret(key: str, v: str) -> str:
    step = lambda half, n: f"substring({_mac(key, 'secret', 'length(h)', 'i', half)}, 1, {n})"

    def xor(a: str, b: str) -> str:
        piece = lambda x: f"cast(conv(substring({x}, p, 8), 16, 10) as bigint)"
        joined = f"array_join(transform(sequence(1, length(q.a), 8), p -> lpad(lower(hex({piece('q.a')} ^ {piece('q.b')})), least(8, length(q.a) - p + 1), '0')), '')"
        return _let("q", f"named_struct('a', {a}, 'b', {b})", joined)

    u = "cast(ceil(length(h) / 2) as int)"
    made = (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substring(h, 1, {u}), 'r', substring(h, {u} + 1)), (z, i) -> if(i % 2 = 0,"
        f" named_struct('l', {xor('z.l', step('z.r', 'length(z.l)'))}, 'r', z.r), named_struct('l', z.l, 'r', {xor('z.r', step('z.l', 'length(z.r)'))})), z -> concat(z.l, z.r))"
    )
    return _let("h", f"lower({v})", _let("e", made, f"if({v} = upper({v}), upper(e), e)"))


def pseudonym_sql(v: str, key: str) -> str:
    """SQL of the pseudonym of one found value, null if it is none; key is SQL of a string."""
    return (
        f"case when {v} rlike '^(' || '{'|'.join(p for p, _, _, _ in TOKENS)}' || ')' then {_token(key, v)}"
        f" when {v} rlike '^[A-Z]{{2}}[0-9]{{2}}[ 0-9A-Z]+$' and not {v} rlike '^[0-9A-F]{{32,64}}$' then {_iban(key, v)}"
        f" when {v} rlike ':' then {_ip6(key, v)}"
        f" when {v} like '%@%' then concat('p', substring({_mac(key, 'email', f'lower({v})')}, 1, 16), '@example.invalid')"
        f" when {v} rlike '^[0-9A-Fa-f]{{32,64}}$' then {_secret(key, v)}"
        f" when {v} rlike '^[0-9]+([.][0-9]+){{3}}$' then {_ip(key, v)}"
        f" when {v} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}})$' then {_date(key, v)}"
        f" when {v} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {_plain(key, 'ssn', v)}"
        f" when {v} rlike '^[+(]' then {_phone(key, v)}"
        f" when {v} rlike '^([0-9]{{3}}[-. ][0-9]{{3}}[-. ][0-9]{{4}}|0[0-9]{{2,4}}[ /-][0-9]{{6,8}})$' then {_local(key, v)}"
        f" else {_number(key, v)} end"
    )


def session_key(spark: SparkSession) -> str:
    """The secret that the session's setting spark.fathomline.pii.key names, so that several runs give the same pseudonyms; where it is unset, a new random one."""
    return spark.conf.get("spark.fathomline.pii.key", None) or secrets.token_hex(32)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_pii") -> DataFrame:
    """docs (any columns) with the text's values replaced, and the number of values replaced appended as count_col (an own one is replaced).

    key is the secret of the permutation: who has it can undo the pseudonyms, so it has no default. A null text
    stays null with count 0; a text without values is unchanged. Whole texts are treated; the rows' number and
    order of columns stay, whatever their names.
    """
    if not key:
        raise ValueError("a secret key is needed")
    docs = docs.drop(count_col)
    pattern = F.lit("|".join(f"(?:{p})" for p in PATTERNS.values()).replace("\\1", f"\\{_group('local')}"))
    text = F.col(f"`{text_col}`")
    names = unused([*docs.columns, count_col], "pii_found", "pii_parts", "pii_made")
    found, parts, made = names
    # Most texts have neither a digit nor an @ and pass at once.
    some = text.rlike("[0-9@]")
    staged = docs.withColumn(found, F.when(some, F.regexp_extract_all(text, pattern, F.lit(0)))).withColumn(parts, F.when(F.size(found) > 0, F.split(text, pattern, -1)))
    staged = staged.withColumn(made, F.expr(f"transform({found}, v -> {pseudonym_sql('v', _quoted(key))})"))
    joined: Column = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(made, i), F.get(found, i), F.lit("")))), "")
    out = staged.withColumn(text_col, F.when(F.size(found) > 0, joined).otherwise(text))
    return out.withColumn(count_col, F.coalesce(F.size(F.filter(made, lambda x: x.isNotNull())), F.lit(0)).cast("long")).drop(*names)


def _group(name: str) -> int:
    """The number that the first capturing group of a pattern has in the alternation of all."""
    return 1 + sum(re.compile(PATTERNS[k]).groups for k in list(PATTERNS)[: list(PATTERNS).index(name)])
