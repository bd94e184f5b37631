"""Format-preserving pseudonyms by Feistel networks, in SQL expressions only.

Found and validated: e-mail addresses (local part), payment card numbers of 13
to 19 digits (Luhn), phone numbers of ten digits with a separator and international ones
(+ country code, 8 to 15 digits in groups), social security numbers, IPv4 addresses (octets up
to 255 without leading zeros), dates from 1900 to 2099
(year-month-day, day/month/year, month/day/year by a parameter; days and months of one or two digits), AWS-style key ids and
hexadecimal secrets of 32 to 64 digits (in capitals too). What looks like one of these but fails
its validation stays as it is.

A value is a tuple of symbols, each from an alphabet of its own (digits, lower or
upper case letters, hex digits, octets). A Feistel network of ROUNDS rounds adds
keyed digests of the symbols at odd places to those at even places and the other
way round, modulo the size of each symbol's alphabet. That is a permutation of all
values of one format: equal values have equal pseudonyms in all documents,
different ones different pseudonyms, and the key reverses it. Separators stay.
A card's last digit is recomputed, so that it still passes Luhn; a security number is
permuted until it is a valid one again; a date becomes one of the same widths: with two-digit
days and months its day's number, 0 to 73048 = 17 * 4297 - 1, permuted as a pair, with a one-digit
month the same among the 54649 = 259 * 211 days until September, with a one-digit day the triple of day,
month and year. The country prefix of a phone number, the domain of an address and the prefix of a key id stay.

A null text stays null; empty texts and those without such values are unchanged, byte for byte.
Repeated rows give equal rows; null doc_ids stay. The work grows in proportion with a text, and
with a value, of any length. Where two formats fit, the one listed first is taken. An empty table gives no rows. Extra columns are ignored by `pseudonyms`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = "wayweave-demo-key"
ROUNDS = 8

# The formats that are looked for, in order of preference.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "intl": r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-][0-9]{1,5}){2,6}(?![0-9A-Za-z])",
    "keyid": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "hex": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
DAYS, UNTIL_SEPTEMBER = (17, 4297), (259, 211)
#: Permutations at most until a security number is valid (one in nine isn't).
WALK = 64


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def network(symbols: str, radix: str, kind: str, key: str = KEY, rounds: int = ROUNDS, back: bool = False) -> str:
    """Permuted array<bigint>, from arrays of symbols and of the size of each one's alphabet.

    Round r digests the symbols at places of parity r mod 2 once and adds 16-bit pieces
    of digests derived from that, one for every 64 symbols, to the others: symbol j takes piece j/2.
    """
    order = f"sequence({rounds - 1}, 0, -1)" if back else f"sequence(0, {rounds - 1})"
    seen = "array_join(filter(s, (x, i) -> i % 2 = r % 2), ',')"
    base = f"sha2(concat({_quote(key + '|' + kind)}, '|', cast(r as string), '|', cast(size(s) as string), '|', {seen}), 256)"
    blocks = "transform(sequence(0, (greatest(size(s), 1) - 1) div 64), b -> sha2(concat(base, '|', cast(b as string)), 512))"
    piece = "cast(conv(substr(bs[j div 64], 4 * ((j % 64) div 2) + 1, 4), 16, 10) as bigint)"
    moved = f"transform(s, (x, j) -> if(j % 2 = r % 2, x, pmod(x {'-' if back else '+'} {piece}, {radix}[j])))"
    return f"aggregate({order}, {symbols}, (s, r) -> {_let(base, 'base', _let(blocks, 'bs', moved))})"


def _alphabet(c: str, kind: str) -> str:
    if kind == "hex":
        return _quote(HEX)
    return f"case when {c} between '0' and '9' then '{DIGITS}' when {c} between 'a' and 'z' then '{LOWER}' when {c} between 'A' and 'Z' then '{UPPER}' end"


def _refilled(text: str, signs: str, pattern: str) -> str:
    """text with its parts that match `pattern` (one character) replaced by an array of signs, in order."""
    return f"array_join(flatten(zip_with(split({text}, '{pattern}', -1), {signs}, (a, b) -> array(a, coalesce(b, '')))), '')"


def _permuted(text: str, kind: str, key: str, back: bool) -> str:
    """text with its letters and digits permuted in their places."""
    chars = f"regexp_extract_all({text}, '[0-9A-Za-z]', 0)"
    symbols = f"transform(cs, c -> cast(instr({_alphabet('c', kind)}, c) - 1 as bigint))"
    radix = f"transform(cs, c -> cast(length({_alphabet('c', kind)}) as bigint))"
    signs = f"zip_with(cs, ps, (c, p) -> substr({_alphabet('c', kind)}, cast(p as int) + 1, 1))"
    inner = _let(network("ss", "rs", kind, key, back=back), "ps", _refilled(text, signs, "[0-9A-Za-z]"))
    return _let(chars, "cs", _let(symbols, "ss", _let(radix, "rs", inner)))


def _luhn(digits: str) -> str:
    """Luhn sum, of an array of digits as bigint, in which the last one counts once."""
    return (f"aggregate(transform(reverse({digits}), (d, i) -> if(i % 2 = 0, d, (d * 2) div 10 + (d * 2) % 10)), 0L, (a, d) -> a + d)")


def _numbers(text: str) -> str:
    return f"transform(filter(split(regexp_replace({text}, '[^0-9]', ''), ''), c -> c <> ''), c -> cast(c as bigint))"


def _card(m: str, key: str, back: bool) -> str:
    body = _let(network("slice(ds, 1, size(ds) - 1)", "transform(ds, d -> 10L)", "card", key, back=back), "ps",
                f"concat(ps, array(pmod(-{_luhn('concat(ps, array(0L))')}, 10)))")
    made = _let(body, "fs", _refilled(m, "transform(fs, f -> cast(f as string))", "[0-9]"))
    return _let(_numbers(m), "ds", f"if({_luhn('ds')} % 10 = 0 and array_max(ds) > 0, {made}, {m})")


def _ip(m: str, key: str, back: bool) -> str:
    octets = f"transform(split({m}, '[.]'), x -> cast(x as bigint))"
    made = f"array_join({network('os', 'array(256L, 256L, 256L, 256L)', 'ip', key, back=back)}, '.')"
    return _let(octets, "os", f"if(array_max(os) <= 255 and not {m} rlike '(^|[.])0[0-9]', {made}, {m})")


def _ssn(m: str, key: str, back: bool) -> str:
    valid = "substr({0}, 1, 3) not in ('000', '666') and {0} < '9' and substr({0}, 5, 2) <> '00' and substr({0}, 8) <> '0000'"
    walk = f"aggregate(sequence(1, {WALK}), {m}, (v, i) -> if(i > 1 and {valid.format('v')}, v, {_permuted('v', 'ssn', key, back)}))"
    return f"if({valid.format(m)}, {walk}, {m})"


def _pair(n: str, sizes: tuple[int, int], kind: str, key: str, back: bool) -> str:
    """A number below the product of two sizes, permuted as a pair."""
    q = network(f"array(cast({n} div {sizes[1]} as bigint), cast({n} % {sizes[1]} as bigint))", f"array({sizes[0]}L, {sizes[1]}L)", kind, key, back=back)
    return _let(q, "q", f"cast(q[0] * {sizes[1]} + q[1] as int)")


def _date(m: str, key: str, back: bool, month_first: bool) -> str:
    """Dates by widths: the day's number; until September with a month of one digit; (day, month, year) with a day of one digit."""
    day, month = (1, 0) if month_first else (0, 1)
    parts = f"if(contains({m}, '/'), transform(array({day}, {month}, 2), i -> split({m}, '/')[i]), reverse(split({m}, '-')))"
    real = "try_to_date(concat_ws('-', p[2], lpad(p[1], 2, '0'), lpad(p[0], 2, '0')), 'yyyy-MM-dd')"
    whole = _let(_pair("datediff(t, date'1900-01-01')", DAYS, "date", key, back), "n", "date_add(date'1900-01-01', n)")
    start = "(({0} - 1900) * 273 + ({0} - 1901) div 4)"  # days until September before a year; 1900 has no 29 February
    first = _pair(f"({start.format('year(t)')} + dayofyear(t) - 1)", UNTIL_SEPTEMBER, "early date", key, back)
    years = "transform(array(-1, 0, 1), z -> 1900 + n * 4 div 1093 + z)"
    early = _let(first, "n", _let(f"cast(array_max(filter({years}, y -> y >= 1900 and {start.format('y')} <= n)) as int)", "y", f"date_add(make_date(y, 1, 1), cast(n - {start.format('y')} as int))"))
    triple = network("array(cast(day(t) - 1 as bigint), cast(month(t) - 1 as bigint), cast(year(t) - 1900 as bigint))", "array(9L, if(length(p[1]) = 1, 9L, 12L), 200L)", "short day", key, back=back)
    short = _let(triple, "q", "make_date(cast(q[2] + 1900 as int), cast(q[1] + 1 as int), cast(q[0] + 1 as int))")
    made = f"case when length(p[0]) = 1 then {short} when length(p[1]) = 1 then {early} else {whole} end"
    wide = lambda i, field: f"lpad(cast({field}(u) as string), length(p[{i}]), '0')"
    slashed = f"concat_ws('/', {', '.join([wide(1, 'month'), wide(0, 'day')] if month_first else [wide(0, 'day'), wide(1, 'month')])}, cast(year(u) as string))"
    shown = _let(made, "u", f"if(contains({m}, '/'), {slashed}, date_format(u, 'yyyy-MM-dd'))")
    return _let(parts, "p", _let(real, "t", f"if(t is null, {m}, {shown})"))


def _hex(m: str, key: str, back: bool) -> str:
    made = _permuted(f"lower({m})", "hex", key, back)
    return f"if({m} = lower({m}), {made}, upper({made}))"


def _intl(m: str, key: str, back: bool) -> str:
    """The country code and its separator stay."""
    front = f"length(regexp_extract({m}, '^[+][0-9]+.', 0))"
    made = f"concat(substr({m}, 1, {front}), {_permuted(f'substr({m}, {front} + 1)', 'intl', key, back)})"
    return f"if(length(regexp_replace({m}, '[^0-9]', '')) between 8 and 15, {made}, {m})"


def _kind(m: str) -> str:
    """Which format a match has; each pattern is tried on the whole match."""
    plain = {k: p.replace("++", "+") for k, p in PATTERNS.items()}
    cases = " ".join(f"when {m} rlike {_quote('^' + p + '$')} then '{k}'" for k, p in plain.items())
    return f"case {cases} end"


def pseudonym(m: str, key: str = KEY, back: bool = False, month_first: bool = False) -> str:
    """SQL for the pseudonym of a matched value (or, with back, the value of a pseudonym)."""
    at = f"instr({m}, '@')"
    front = f"if({m} like '+1%', 2, 0)"
    cases = {
        "email": f"concat({_permuted(f'substr({m}, 1, {at} - 1)', 'email', key, back)}, substr({m}, {at}))",
        "ip": _ip(m, key, back),
        "date": _date(m, key, back, month_first),
        "ssn": _ssn(m, key, back),
        "phone": f"concat(substr({m}, 1, {front}), {_permuted(f'substr({m}, {front} + 1)', 'phone', key, back)})",
        "intl": r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-][0-9]{1,5}){2,6}(?![0-9A-Za-z])",
    "keyid": f"concat(substr({m}, 1, 4), {_permuted(f'substr({m}, 5)', 'keyid', key, back)})",
        "intl": _intl(m, key, back),
        "hex": _hex(m, key, back),
        "card": _card(m, key, back),
    }
    return _let(_kind(m), "kind", "case " + " ".join(f"when kind = '{k}' then {e}" for k, e in cases.items()) + f" else {m} end")


def pseudonyms(documents: DataFrame, key: str = KEY, back: bool = False, month_first: bool = False) -> DataFrame:
    """One row per document: doc_id, text (pseudonymised), n_values (that were replaced), kinds (of these, sorted)."""
    pattern = _quote("|".join(f"(?:{p})" for p in PATTERNS.values()))
    found = documents.select("doc_id", "text").withColumn("found", F.expr(f"regexp_extract_all(text, {pattern}, 0)"))
    made = f"transform(found, m -> {pseudonym('m', key, back, month_first)})"
    hit = "coalesce(size(found), 0) > 0"
    # one struct, so that the optimizer doesn't evaluate the expression once for each output column
    out = found.withColumn("done", F.expr(f"""if({hit}, {_let(made, 'fresh', f'''named_struct(
        'text', array_join(flatten(zip_with(split(text, {pattern}, -1), fresh, (a, b) -> array(a, coalesce(b, '')))), ''),
        'n', cast(size(filter(zip_with(found, fresh, (a, b) -> a <> b), x -> x)) as bigint),
        'kinds', array_sort(array_distinct(transform(filter(zip_with(found, fresh, (a, b) -> if(a <> b, a, null)), x -> x is not null), x -> {_kind('x')}))))''')},
        named_struct('text', text, 'n', 0L, 'kinds', cast(array() as array<string>)))"""))
    return out.select("doc_id", F.col("done.text").alias("text"), F.col("done.n").alias("n_values"), F.col("done.kinds").alias("kinds"))
