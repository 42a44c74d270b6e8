"""Format-preserving pseudonyms for private values in text, in DataFrame functions only.

Values are found by one pattern, validated (check digit, calendar, octets, number plan), and permuted by a keyed
Feistel network inside their own format. The network adds a keyed hash of one half to the other half, letter by
letter or as a remainder, so it is a bijection of the format: equal values get equal pseudonyms in every document,
different values get different ones, and the holder of the key can go back. An e-mail name counts as the same in any
letter case and its pseudonym is in lower case, so there the way back gives lower case too. Where a format holds values
that are not valid, the permutation is repeated until it gives a valid one, which is a bijection of the valid ones.
nn/nn/yyyy is read as day and month, and as month and day where that is no date.

===========  =============================================  =======================================================
kind         valid if                                       what is permuted
===========  =============================================  =======================================================
card         13-19 digits that pass the Luhn check          all digits but the last, which is computed anew
phone        an optional country code and ten digits        the ten digits
ssn          three groups (3-2-4), none of them all zero    all digits
date         a day from 1900 to 2099                        the day; month-first ones keep a day over 12
ip           four numbers of at most 255, no leading zero   the 32 bits
email        a name of at most 64 characters, @, and a      letters and digits of the name
             domain of 2 to 127 parts
secret       hexadecimal digits behind a name such as token the digits; letter case is kept
===========  =============================================  =======================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindmill.llm.common import read

KEY = "change-me"
ROUNDS = 10
KINDS = ("card", "phone", "ssn", "date", "ip", "email", "secret")

#: The formats that are searched for, longest first.
PATTERNS = {
    # the look-ahead comes first because it fails at once nearly everywhere
    "secret": r"""(?=[0-9a-fA-F]{16})(?<=(?:\b|_)(?i:token|secret|password|api_key|key)["']?[ \t]{0,8}[:=][ \t]{0,8}["']?)"""
              r"(?:[0-9a-f]{16,64}|[0-9A-F]{16,64})(?![\w+/=-])",
    # repeated groups are bounded, as every repetition takes the engine a level deeper
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,126}",
    "long": r"(?<![\d.])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
}
ANY = "|".join(PATTERNS[k] for k in ("secret", "email", "long", "date", "ip", "phone", "ssn"))
DIGITS, HEX, NAME = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"
#: Days from 1900-01-01 to 2099-12-31 are 17 * 4297, the two digits of a day's number.
DAYS, DAY_HIGH, DAY_LOW = 73_049, 17, 4297
#: Steps until a permuted value is valid; of month-first dates three days in five are (over 12), of other kinds more, so
#: more than 64 steps have a chance below 1e-20 for any key.
WALK = 64
SSN_ZERO = "^000|^...00|0000$"  # of the nine digits


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _letters(value: str, alphabet: str, kind: str, key: str) -> str:
    """SQL for a Feistel permutation of the texts of one length over an alphabet."""
    prf = f"sha2(concat_ws('|', {_sql(key)}, '{kind}', i, length(value), t.r), 512)"
    letter = (f"substr('{alphabet}', cast(pmod(instr('{alphabet}', substr(t.l, j + 1, 1)) - 1 + "
              f"cast(conv(concat('0', substr(h, 4 * (j % 32) + 1, 4)), 16, 10) as int), {len(alphabet)}) as int) + 1, 1)")
    added = (f"if(length(t.l) = 0, '', transform(array({prf}), h -> array_join(transform("
             f"sequence(0, length(t.l) - 1), j -> {letter}), ''))[0])")
    halves = "named_struct('l', substr(value, 1, (length(value) + 1) div 2), 'r', substr(value, (length(value) + 1) div 2 + 1))"
    rounds = f"aggregate(sequence(1, {ROUNDS}), {halves}, (t, i) -> named_struct('l', t.r, 'r', {added}), t -> concat(t.l, t.r))"
    return f"transform(array({value}), value -> {rounds})[0]"


def _number(value: str, high: int, low: int, kind: str, key: str) -> str:
    """SQL for a Feistel permutation of 0..high*low-1 (two digits of different bases)."""
    def prf(half: str) -> str:
        return (f"cast(conv(substr(sha2(concat_ws('|', {_sql(key)}, '{kind}', i, {half}), 256), 1, 12), 16, 10) "
                "as bigint)")

    # one round moves the high digit by the low one and then the low digit by the new high one
    first = f"pmod(t.h + {prf('t.l')}, {high}L)"
    step = (f"transform(array({first}), h -> named_struct('h', h, 'l', pmod(t.l + {prf('h')}, {low}L)))[0]")
    start = f"named_struct('h', cast(value div {low} as bigint), 'l', cast(value % {low} as bigint))"
    rounds = f"aggregate(sequence(1, {ROUNDS}), {start}, (t, i) -> {step}, t -> t.h * {low} + t.l)"
    return f"transform(array({value}), value -> {rounds})[0]"


def _refill(template: str, letters: str, kind_of_letter: str) -> str:
    """SQL that puts new letters, in order, at the places of the template's letters of that kind."""
    return (f"transform(array({letters}), z -> aggregate(split({template}, ''), "
            f"named_struct('o', cast('' as string), 'n', 1), (s, c) -> if(c rlike '^{kind_of_letter}$', "
            "named_struct('o', concat(s.o, substr(z, s.n, 1)), 'n', s.n + 1), "
            "named_struct('o', concat(s.o, c), 'n', s.n)), s -> s.o))[0]")


def _luhn(payload: str) -> str:
    """SQL for the check digit of a row of digits."""
    digit = f"cast(substr({payload}, p, 1) as bigint)"
    doubled = f"({digit} * 2 div 10 + {digit} * 2 % 10)"
    return (f"pmod(-aggregate(sequence(1, length({payload})), 0L, (s, p) -> s + if((length({payload}) - p) % 2 = 0, "
            f"{doubled}, {digit})), 10)")


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _day(text: str) -> tuple[str, str]:
    """SQL for the day of a date text (null if there is none) and for the text of a day ``d`` in the same form."""
    forms = [("____-__-__", "yyyy-MM-dd"), ("__/__/____", "dd/MM/yyyy"), ("__.__.____", "dd.MM.yyyy")]
    parsed = " ".join(f"when {text} like '{like}' then try_to_date({text}, '{form}')" for like, form in forms)
    form = " ".join(f"when {text} like '{like}' then date_format(d, '{form}')" for like, form in forms)
    return (f"coalesce(case {parsed} end, try_to_date({text}, 'MM/dd/yyyy'))",
            f"case when {_month_first(text)} then date_format(d, 'MM/dd/yyyy') {form} end")


def _month_first(text: str) -> str:
    """SQL that is true for nn/nn/yyyy where only the second number can be the day."""
    return f"({text} like '__/__/____' and try_to_date({text}, 'dd/MM/yyyy') is null)"


def _kind(m: str) -> str:
    """SQL for the kind of a match, null if it is not valid."""
    digits = _digits(m)
    valid_luhn = (f"transform(array({digits}), x -> {_luhn('left(x, length(x) - 1)')} = cast(right(x, 1) as int))[0]")
    day = _day(m)[0]
    return f"""case when {m} like '%@%' then 'email'
        when {m} rlike '^[0-9a-fA-F]{{16,64}}$' and ({m} rlike '[a-fA-F]' or length({m}) > 19) then 'secret'
        when {m} rlike '^[0-9]{{13,19}}$' or {m} rlike '^[0-9]{{4}}([ -])[0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{4}}$'
            or {m} rlike '^[0-9]{{4}}([ -])[0-9]{{6}}[ -][0-9]{{5}}$' then if({valid_luhn}, 'card', null)
        when {m} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}([/.])[0-9]{{2}}[/.][0-9]{{4}})$'
            then if(year({day}) between 1900 and 2099, 'date', null)
        when {m} rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$'
            then if(forall(split({m}, '[.]'), x -> cast(x as int) <= 255 and cast(cast(x as int) as string) = x), 'ip', null)
        when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$'
            then if(not {m} rlike '^000|-00-|0000$', 'ssn', null)
        else 'phone' end"""


def _pseudonym(m: str, kind: str, key: str) -> str:
    """SQL for the pseudonym of a match of a kind."""
    digits = _digits(m)
    payload = _letters("left(x, length(x) - 1)", DIGITS, "card", key)
    card = (f"transform(array({digits}), x -> transform(array({payload}), y -> "
            f"concat(y, cast({_luhn('y')} as string)))[0])[0]")
    phone = f"concat(left({digits}, length({digits}) - 10), {_letters(f'right({digits}, 10)', DIGITS, 'phone', key)})"
    ssn = (f"aggregate(sequence(1, {WALK}), {digits}, (v, w) -> "
           f"if(w = 1 or v rlike '{SSN_ZERO}', {_letters('v', DIGITS, 'ssn', key)}, v))")
    day, form = _day(m)
    number = f"datediff({day}, date'1900-01-01')"
    moved = _number(number, DAY_HIGH, DAY_LOW, "date", key)
    # month-first dates stay such: the permutation is repeated until the day is over 12 again
    outside = "(w = 1 or day(date_add(date'1900-01-01', cast(v as int))) <= 12)"
    walked = (f"aggregate(sequence(1, {WALK}), cast({number} as bigint), (v, w) -> "
              f"if({outside}, {_number('v', DAY_HIGH, DAY_LOW, 'date', key)}, v))")
    moved = f"if({_month_first(m)}, {walked}, {moved})"
    date = f"transform(array(date_add(date'1900-01-01', cast({moved} as int))), d -> {form})[0]"
    bits = f"aggregate(split({m}, '[.]'), 0L, (s, x) -> s * 256L + cast(x as bigint))"
    ip = (f"transform(array({_number(bits, 65536, 65536, 'ip', key)}), v -> concat_ws('.', v div 16777216, "
          "(v div 65536) % 256, (v div 256) % 256, v % 256))[0]")
    name = f"regexp_replace(lower(substring_index({m}, '@', 1)), '[^a-z0-9]', '')"
    local = _refill(f"substring_index({m}, '@', 1)", _letters(name, NAME, "email", key), "[A-Za-z0-9]")
    email = f"concat({local}, '@', substring_index({m}, '@', -1))"
    secret = _letters(f"lower({m})", HEX, "secret", key)
    secret = f"if({m} = lower({m}), {secret}, upper({secret}))"
    return f"""case when {kind} = 'card' then {_refill(m, card, '[0-9]')}
        when {kind} = 'phone' then {_refill(m, phone, '[0-9]')}
        when {kind} = 'ssn' then {_refill(m, ssn, '[0-9]')}
        when {kind} = 'date' then {date} when {kind} = 'ip' then {ip}
        when {kind} = 'email' then {email} when {kind} = 'secret' then {secret} else {m} end"""


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with private values in ``text`` replaced, and ``found``: array<struct(value, kind, pseudonym)>.

    Values that are not valid stay as they are and are not listed. Null texts stay null with an empty list. Rows are
    judged one by one, without an exchange, and texts of any length whole: the search is linear in the text.
    ``found`` replaces a column of that name.
    """
    body = f"`{text}`"
    matched = docs.drop("found").withColumn("found", F.expr(
        f"if({body} rlike '[0-9@]', regexp_extract_all({body}, {_sql(ANY)}, 0), cast(array() as array<string>))"))
    kinds = f"transform(found, m -> named_struct('m', m, 'k', {_kind('m')}))"
    told = matched.withColumn("found", F.when(F.size("found") > 0, F.expr(
        f"transform({kinds}, x -> named_struct('value', x.m, 'kind', x.k, 'pseudonym', {_pseudonym('x.m', 'x.k', key)}))")))
    pieces = f"split({body}, {_sql(ANY)}, -1)"
    filled = (f"concat_ws('', flatten(zip_with({pieces}, transform(found, x -> x.pseudonym), "
              "(a, b) -> array(a, coalesce(b, '')))))")
    replaced = told.withColumn(text, F.expr(f"if(size(found) > 0, {filled}, {body})"))
    valid = F.coalesce(F.filter("found", lambda x: x["kind"].isNotNull()), F.array().cast(told.schema["found"].dataType))
    return replaced.withColumn("found", valid)


def op9_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text with pseudonyms in place of private values, and the number of values by kind."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    done = pseudonymise(docs)
    counts = [F.expr(f"size(filter(found, x -> x.kind = '{kind}'))").alias(f"n_{kind}") for kind in KINDS]
    return done.select("doc_id", "text", F.size("found").alias("n_replaced"), *counts)


QUERIES = {"op9_feistel_pseudonyms": op9_feistel_pseudonyms}
ORACLES: dict[str, str] = {}
