"""Format-preserving pseudonyms for personal numbers, dates and addresses, in SQL functions alone.

One regular expression finds candidates; each is validated (Luhn digit, numbering plan, calendar, ranges). A valid one is permuted
within its format by a keyed Feistel network: the value is split into two halves, and in each of ``ROUNDS`` rounds a keyed hash of one half
is added to the other, modulo the number of values that half can take. This is a bijection, so equal values get equal
pseudonyms in all documents and different ones differ; separators and the kinds of characters stay.

kind   | valid if                                         | permuted among
card   | 13-19 digits, plain, 4-4-4-4 or 4-6-5, Luhn digit right | numbers of that length with a right Luhn digit
phone  | area and exchange of 10 digits begin with 2-9    | such numbers
phone  | written +1 or (area), area begins with 0 or 1     | numbers of that area
ssn    | ddd-dd-dddd, no part zero, area under 900        | such numbers
ip     | four numbers up to 255                           | all addresses; with a leading zero anywhere, all are written with three digits
date   | a day of 1900-2099; year first, or day first     | days of 1900-2099
date   | month first, where that isn't a day first        | days 13-28 of all months; of later days only the year changes
email  | name@host.domain                                 | names with letters and digits in the same places

Defined results: a null text stays null, with counts of 0, and an empty one empty. Invalid candidates stay as they are, as do forms not listed
(numbers of other countries, dates without leading zeros, IPv6). Candidates don't overlap: the leftmost is taken, of several there the first kind.
Very long texts are taken whole; no expression recurses or goes back over what it has read. Repeated rows are answered one by one; an empty table gives
no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("card", "phone", "ssn", "ip", "date", "email")
ROUNDS = 10
FREE, END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
CANDIDATE = "|".join(
    (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        FREE + r"(?:19|20)[0-9]{2}([-/.])[0-9]{2}\1[0-9]{2}" + END,
        FREE + r"[0-9]{2}([-/.])[0-9]{2}\2(?:19|20)[0-9]{2}" + END,
        FREE + r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])",
        r"(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])|" + FREE + r"\([0-9]{3}\) ?|" + FREE + r"[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}" + END,
        FREE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + END,
        FREE + r"[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{4}" + END,
        FREE + r"[0-9]{4}([ -])[0-9]{6}\4[0-9]{5}" + END,
        FREE + r"[0-9]{13,19}" + END,
    )
)
#: Days of 1900-2099 are 17 x 4297; the first is day -25567 of the epoch.
DAYS, FIRST_DAY = (17, 4297), -25567


def q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(value: str, a: str, b: str, key: str, tweak: str) -> str:
    """SQL for the permuted value, 0 <= value < a * b; all but ``key`` are SQL."""
    f = lambda x: f"cast(conv(substr(sha2(concat_ws('|', {q(key)}, {tweak}, i, {x}), 256), 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({value} as bigint) div ({b}), 'r', cast({value} as bigint) % ({b})), "
        f"(s, i) -> if(i % 2 = 0, named_struct('l', (s.l + {f('s.r')}) % ({a}), 'r', s.r), named_struct('l', s.l, 'r', (s.r + {f('s.l')}) % ({b}))), "
        f"s -> s.l * ({b}) + s.r)"
    )


def luhn_sum(digits: str) -> str:
    """SQL for the Luhn sum of ``digits`` when a check digit is to follow them."""
    return f"aggregate(transform(regexp_extract_all(reverse({digits}), '[0-9]', 0), (c, k) -> if(k % 2 = 0, bigint((2 * int(c)) div 10 + (2 * int(c)) % 10), bigint(c))), bigint(0), (s, x) -> s + x)"


def filled(form: str, digits: str) -> str:
    """SQL for ``form`` with its digits replaced, from left to right, by ``digits``."""
    return f"aggregate(regexp_extract_all({form}, '(?s).', 0), named_struct('o', '', 'k', 1), (s, c) -> if(c between '0' and '9', named_struct('o', concat(s.o, substr({digits}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k)), s -> s.o)"


def bare(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def day(m: str) -> str:
    """SQL for the day number of a date, null if the calendar has no such day."""
    d = bare(m)
    return f"datediff(try_to_date(if({m} rlike '^[0-9]{{4}}[^0-9]', {d}, concat(substr({d}, 5, 4), substr({d}, 3, 2), substr({d}, 1, 2))), 'yyyyMMdd'), date'1900-01-01')"


def month_first(m: str) -> str:
    """SQL for the date that m, two digits, two digits and a year, is with its month first; null if there is none."""
    d = bare(m)
    return f"try_to_date(concat(substr({d}, 5, 4), substr({d}, 1, 4)), 'yyyyMMdd')"


def kind(m: str) -> str:
    """SQL for the kind of a candidate, null if it isn't valid."""
    d = bare(m)
    return f"""case when {m} like '%@%' then 'email'
        when {m} rlike '^([0-9]{{4}}[-/.][0-9]{{2}}[-/.][0-9]{{2}}|[0-9]{{2}}[-/.][0-9]{{2}}[-/.][0-9]{{4}})$' then if({day(m)} is not null or {m} not rlike '^[0-9]{{4}}[^0-9]' and {month_first(m)} is not null, 'date', null)
        when {m} rlike '^[0-9]+([.][0-9]+){{3}}$' then if(forall(split({m}, '[.]'), x -> int(x) < 256), 'ip', null)
        when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if(substr({d}, 1, 3) not in ('000') and substr({d}, 1, 1) <> '9' and substr({d}, 4, 2) <> '00' and substr({d}, 6, 4) <> '0000', 'ssn', null)
        when length({d}) >= 13 then if(({luhn_sum(f"substr({d}, 1, length({d}) - 1)")} + int(right({d}, 1))) % 10 = 0, 'card', null)
        when substr(right({d}, 10), 1, 1) < '2' or substr(right({d}, 10), 4, 1) > '1' then 'phone' end"""


def card(m: str, key: str) -> str:
    d = bare(m)
    payload = f"lpad(cast({feistel(f'bigint(substr({d}, 1, length({d}) - 1))', f'bigint(power(10, (length({d}) - 1) div 2))', f'bigint(power(10, length({d}) - 1 - (length({d}) - 1) div 2))', key, f"concat('card', length({d}))")} as string), length({d}) - 1, '0')"
    # lambdas over one element give the payload a name
    return f"element_at(transform(array({payload}), p -> {filled(m, f"concat(p, (10 - {luhn_sum('p')} % 10) % 10)")}), 1)"


def phone(m: str, key: str) -> str:
    d = f"right({bare(m)}, 10)"
    v = f"((bigint(substr({d}, 1, 3)) - 200) * 800 + bigint(substr({d}, 4, 3)) - 200) * 10000 + bigint(substr({d}, 7, 4))"
    out = f"element_at(transform(array({feistel(f'({v})', '640000', '10000', key, q('phone'))}), v -> concat(cast(v div 8000000 + 200 as string), cast((v div 10000) % 800 + 200 as string), lpad(cast(v % 10000 as string), 4, '0'))), 1)"
    # an area that begins with 0 or 1 isn't in the plan; it stays, so that such numbers stay apart from those in the plan
    rest = f"concat(substr({d}, 1, 3), lpad(cast({feistel(f'bigint(substr({d}, 4, 7))', '1000', '10000', key, f"concat('phone', substr({d}, 1, 3))")} as string), 7, '0'))"
    out = f"if(substr({d}, 1, 1) < '2', {rest}, {out})"
    lead = f"if(length({bare(m)}) > 10, substr({bare(m)}, 1, length({bare(m)}) - 10), '')"
    return f"element_at(transform(array({out}), p -> {filled(m, f'concat({lead}, p)')}), 1)"


def ssn(m: str, key: str) -> str:
    d = bare(m)
    v = f"((bigint(substr({d}, 1, 3)) - 1) * 99 + bigint(substr({d}, 4, 2)) - 1) * 9999 + bigint(substr({d}, 6, 4)) - 1"
    return f"element_at(transform(array({feistel(f'({v})', f'{899 * 99}', '9999', key, q('ssn'))}), v -> concat(lpad(cast(v div {99 * 9999} + 1 as string), 3, '0'), '-', lpad(cast((v div 9999) % 99 + 1 as string), 2, '0'), '-', lpad(cast(v % 9999 + 1 as string), 4, '0'))), 1)"


def ip(m: str, key: str) -> str:
    v = f"aggregate(split({m}, '[.]'), bigint(0), (s, x) -> s * 256 + bigint(x))"
    return f"element_at(transform(array({feistel(v, '65536', '65536', key, q('ip'))}), v -> array_join(transform(array(v div 16777216, (v div 65536) % 256, (v div 256) % 256, v % 256), x -> if({m} rlike '(^|[.])0[0-9]', lpad(cast(x as string), 3, '0'), cast(x as string))), '.')), 1)"


def date(m: str, key: str) -> str:
    new = f"date_format(date_add(date'1900-01-01', int({feistel(day(m), str(DAYS[0]), str(DAYS[1]), key, q('date'))})), if({m} rlike '^[0-9]{{4}}[^0-9]', 'yyyyMMdd', 'ddMMyyyy'))"
    d = bare(m)
    v = f"(bigint(substr({d}, 5, 4)) - 1900) * 12 + bigint(substr({d}, 1, 2)) - 1) * 16 + bigint(substr({d}, 3, 2)) - 13"
    early = f"element_at(transform(array({feistel(f'(({v})', '2400', '16', key, q('month first'))}), v -> concat(lpad(cast((v div 16) % 12 + 1 as string), 2, '0'), lpad(cast(v % 16 + 13 as string), 2, '0'), cast(v div 192 + 1900 as string))), 1)"
    leap = f"concat('0229', cast(1904 + 4 * {feistel(f'(bigint(substr({d}, 5, 4)) - 1904) div 4', '7', '7', key, q('leap'))} as string))"
    late = f"concat(substr({d}, 1, 4), cast(1900 + {feistel(f'bigint(substr({d}, 5, 4)) - 1900', '20', '10', key, f'substr({d}, 1, 4)')} as string))"
    other = f"case when substr({d}, 3, 2) < '29' then {early} when substr({d}, 1, 4) = '0229' then {leap} else {late} end"
    return f"element_at(transform(array(if({day(m)} is null, {other}, {new})), p -> {filled(m, 'p')}), 1)"


def email(m: str, key: str) -> str:
    """The name's letters and digits, in pieces of up to 11 characters, as numbers whose places have 26 or 10 values."""
    base = lambda c: f"case when {c} between '0' and '9' then 48 when {c} between 'a' and 'z' then 97 when {c} between 'A' and 'Z' then 65 end"
    radix = lambda c: f"bigint(case when {c} between '0' and '9' then 10 when {c} between 'a' and 'z' or {c} between 'A' and 'Z' then 26 else 1 end)"
    digit = lambda c: f"coalesce(ascii({c}) - {base(c)}, 0)"
    product = lambda cs: f"aggregate({cs}, bigint(1), (s, c) -> s * {radix('c')})"
    value = f"aggregate(cs, bigint(0), (s, c) -> s * {radix('c')} + {digit('c')})"
    mask = "array_join(transform(cs, c -> case when c between '0' and '9' then '0' when c between 'a' and 'z' then 'a' when c between 'A' and 'Z' then 'A' else c end), '')"
    permuted = feistel(value, product("slice(cs, 1, size(cs) div 2)"), product("slice(cs, size(cs) div 2 + 1, size(cs))"), key, f"concat('email', k, {mask})")
    back = f"aggregate(reverse(cs), named_struct('v', {permuted}, 'o', ''), (s, c) -> named_struct('v', s.v div {radix('c')}, 'o', concat(coalesce(char({base('c')} + s.v % {radix('c')}), c), s.o)), s -> s.o)"
    named = f"array_join(transform(regexp_extract_all(substring_index({m}, '@', 1), '.{{1,11}}', 0), (w, k) -> element_at(transform(array(regexp_extract_all(w, '.', 0)), cs -> {back}), 1)), '')"
    return f"concat({named}, '@', substring_index({m}, '@', -1))"


def pseudonym(m: str, key: str) -> str:
    """SQL for what stands in place of the candidate ``m``, a struct (kind, v) named ``m``."""
    makers = {"card": card, "phone": phone, "ssn": ssn, "ip": ip, "date": date, "email": email}
    return f"case {m}.kind " + " ".join(f"when '{k}' then {f(f'{m}.v', key)}" for k, f in makers.items()) + f" else {m}.v end"


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the text with pseudonyms, and the number of each kind, for each row of ``docs``."""
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text")).withColumn("_m", F.expr(f"regexp_extract_all(_text, {q(CANDIDATE)}, 0)"))
    typed = found.withColumn("_k", F.when(F.size("_m") > 0, F.expr(f"transform(_m, v -> named_struct('v', v, 'kind', {kind('v')}))")))
    gaps = f"split(_text, {q(CANDIDATE)}, -1)"
    new = F.expr(f"element_at(transform(array({gaps}), g -> concat(g[0], array_join(zip_with(slice(g, 2, size(g)), transform(_k, m -> {pseudonym('m', key)}), (x, p) -> concat(p, x)), ''))), 1)")
    return typed.select("doc_id", F.when(F.col("_k").isNull(), F.col("_text")).otherwise(new).alias("text"), *(F.expr(f"bigint(coalesce(size(filter(_k, m -> m.kind = '{k}')), 0))").alias(f"n_{k}") for k in KINDS))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), key="test key")
