"""Surrogates for personal data: keyed, type-consistent, distinct, and the same for the same entity everywhere.

Entities are found by one pattern; the text between them stays as it is. A surrogate keeps the format: digits become
digits, letters letters of the same case, separators stay; card numbers keep a valid check digit, IBANs their country
and valid check digits, addresses of hosts stay addresses, mail keeps its top-level domain. Names after a title keep
gender and script: they are drawn from lists by both. Every figure comes from SHA-512 over key, type, canonical form
(lower case, without separators) and attempt, so one entity has one surrogate in all documents, however it is written.

Collision checks: over the distinct entities of the corpus, an attempt fails where two entities get one surrogate
or where a surrogate is itself an entity of the corpus. The smallest entity keeps the surrogate, the others try again
until none fails, many at a time after some rounds; where a format has no free value left, its entities change places
among each other. Only rows that hold an entity with a later attempt are joined with these attempts.

Defined cases: null texts stay null, texts without entities stay as they are; repeated rows are handled row by row;
columns other than the text pass unchanged, whatever their names (but those that start with ``_pii_``); an empty table
gives an empty result. Names are drawn from lists and made distinct by a second, syllable-built part.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattfold.llm.graph import stored

KEY, ROUNDS, WIDE, LONG, LETTER = "surrogates", 16, 512, 256, r"\p{L}"
_NEXT = r"(?:[ ./()-]{0,2}(?!(?:\d{1,3}\.){3}\d)\d)"  # one digit more, but not the first one of a host address
#: A plus or a leading zero and 7 to 15 digits in any groups; other groups of at least seven digits, but not
#: two years; fewer digits after a word for telephone.
PHONE = (
    rf"(?<![\w+])\+(?:1[ .-]?\(?\d{{3}}\)?[ .-]?\d{{3}}[ .-]?\d{{4}}(?!\d)|\d{_NEXT}{{6,14}}(?!\d))"
    rf"|(?<![\w+])(?<!\d[./-])(?!\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}(?!\d))(?=\(?0\d{{1,5}}[ ./)-])\(?0\d{_NEXT}{{5,13}}(?!\d|\.\d)"
    r"|(?<![\w+])(?!(?:1\d|20)\d\d[ .-](?:1\d|20)\d\d(?!\d|[ .-]\d))"
    r"(?:\(\d{2,4}\)[ .-]?\d{2,4}[ .-]\d{3,4}(?:[ .-]\d{2,4})?|\d{2,4}[ .-]\d{3,4}[ .-]\d{2,4}|\d{3}[ .-]\d{4}|\d{4}[ .-]\d{3,4})(?!\d|\.\d)"
    r"|(?=\d)(?<=(?i:phone|telephone|telefon|tel|mobile|mobil|fax|téléphone|teléfono)[.:]{0,2} {0,2})\d{2,4}[ .-]\d{3,4}(?!\d|\.\d)"
)
#: Patterns of the entities, in order of precedence.
PATTERNS = {
    # Of the lengths an address may have: up to 64 characters before the sign, labels of up to 63 after it. Bounds keep the work linear.
    "mail": r"(?<![\p{L}\p{Nd}])[\p{L}\p{Nd}][\p{L}\p{Nd}._%+-]{0,63}+@[\p{L}\p{Nd}][\p{L}\p{Nd}-]{0,62}(?:\.[\p{L}\p{Nd}-]{1,63}){0,30}\.[A-Za-z]{2,63}(?![A-Za-z])",
    "secret": r"(?i:password|passwd|api_key|secret|token)(?:[=:]|[\"']?\s{0,4}[=:]\s{0,4}(?:[\"']|(?=[A-Za-z_\-]*\d)))[A-Za-z0-9_\-]{6,}",
    "iban": r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{8,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3}(?![\w.]))?)\b",
    "host": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": PHONE,
    "name": r"\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?|(?:господин|госпожа) \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
#: Names by gender and script.
NAMES = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Julia", "Laura", "Marta", "Nora", "Sofia"],
    ("m", "latin"): ["Adam", "Daniel", "Felix", "Jonas", "Leon", "Martin", "Oskar", "Simon"],
    ("f", "cyrillic"): ["Анна", "Вера", "Елена", "Мария", "Нина", "Ольга", "Софья", "Юлия"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Иван", "Олег", "Павел", "Роман"],
}
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Señora|госпожа)"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind(e: str) -> str:
    """SQL: the type of an entity. Only telephone numbers are known by what stands before them."""
    return "case " + " ".join(f"when rlike({e}, {_quoted('^(?:' + p + ')$')}) then '{k}'" for k, p in PATTERNS.items()) + " else 'phone' end"


def _value(e: str) -> str:
    """SQL: the value of a secret, without key, sign and quote."""
    return f"regexp_extract({e}, '[A-Za-z0-9_-]+$', 0)"


def canonical(e: str) -> str:
    """SQL: what is equal for the same entity in other writing: names without title, host addresses whole, others letters and digits."""
    plain = f"lower(regexp_replace({e}, '[^A-Za-z0-9]', ''))"
    return (
        f"case {kind(e)} when 'name' then lower(regexp_replace({e}, '^\\\\S+ ', '')) when 'mail' then lower({e}) when 'host' then {e} "
        f"when 'secret' then {_value(e)} else {plain} end"
    )


def _byte(d: str, i: str) -> str:
    return f"cast(conv(substr({d}, (2 * ({i})) % 126 + 1, 2), 16, 10) as int)"


def _drawn(e: str, d: str) -> str:
    """SQL: the entity with every letter and digit drawn anew by its place among letters and digits (of entities longer
    than ``LONG``, mails and secrets whose writing does not vary, by its place)."""

    def by(place: str) -> str:
        return (
            f"array_join(transform(split({e}, ''), (c, i) -> case when c rlike '[0-9]' then cast({_byte(d, place)} % 10 as string) "
            f"when c rlike '[a-z]' then chr(97 + {_byte(d, place)} % 26) when c rlike '[A-Z]' then chr(65 + {_byte(d, place)} % 26) "
            f"when c rlike {_quoted(LETTER)} then chr(97 + {_byte(d, place)} % 26) else c end), '')"
        )

    return f"if(length({e}) > {LONG}, {by('i')}, {by(f"length(regexp_replace(substr({e}, 1, i), '[^A-Za-z0-9]', ''))")})"


def _luhn(t: str) -> str:
    """SQL: a drawn number with its last digit set so that the check sum holds."""
    digits = f"regexp_replace({t}, '[^0-9]', '')"
    total = (
        f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> case when i = 0 then 0 when i % 2 = 1 then int(c) * 2 - if(int(c) > 4, 9, 0) else int(c) end), 0, (a, x) -> a + x)"
    )
    return f"concat(left({t}, length({t}) - 1), cast((10 - {total} % 10) % 10 as string))"


def _iban(e: str, t: str) -> str:
    """SQL: country kept, account drawn, check digits by remainder 97."""
    letters = f"concat(substr(regexp_replace({t}, ' ', ''), 5), left({e}, 2), '00')"
    number = f"array_join(transform(split({letters}, ''), c -> if(c rlike '[A-Z]', cast(ascii(c) - 55 as string), c)), '')"
    rest = f"aggregate(split({number}, ''), 0, (a, c) -> (a * 10 + int(c)) % 97)"
    return f"concat(left({e}, 2), lpad(cast(98 - {rest} as string), 2, '0'), substr({t}, 5))"


def _name(e: str, d: str, attempt: str) -> str:
    """SQL: title kept; first name from the list of its gender and script, then drawn syllables: four, and one more with
    every eight attempts, so names don't run out."""
    listed = {k: "array(" + ", ".join(map(_quoted, v)) + ")" for k, v in NAMES.items()}
    cyrillic = f"rlike({e}, '[А-Яа-яЁё]')"
    pick = f"{_byte(d, '0')} % 8"
    first = (
        f"case when {cyrillic} then if(rlike({e}, {_quoted(FEMALE)}), {listed['f', 'cyrillic']}[{pick}], {listed['m', 'cyrillic']}[{pick}]) "
        f"else if(rlike({e}, {_quoted(FEMALE)}), {listed['f', 'latin']}[{pick}], {listed['m', 'latin']}[{pick}]) end"
    )
    parts = f"if({cyrillic}, array('бо','ве','га','ди','ко','ле','ми','но','ра','со','ту','фе','ха','ши','ню','я'), array('ba','ce','di','fo','ga','he','ki','lo','ma','ne','po','ra','si','to','vu','ze'))"
    last = f"initcap(array_join(transform(sequence(1, 4 + least(int({attempt}) div 8, 56)), j -> {parts}[{_byte(d, 'j')} % 16]), ''))"
    return f"concat(substring_index({e}, ' ', 1), ' ', {first}, ' ', {last})"


def _lead(e: str) -> str:
    """SQL: what a telephone number keeps: the country's number, or the zeros before an area's number."""
    return f"regexp_extract({e}, '^[+][0-9]+(?=[^0-9])|^[(]?0+', 0)"


def surrogate(e: str, attempt: str = "0", key: str = KEY) -> str:
    """SQL: the surrogate of an entity at an attempt."""
    d = "_d"
    made = _drawn(e, d)
    body = f"""case {kind(e)}
        when 'name' then {_name(e, d, attempt)}
        when 'mail' then concat({_drawn(f"left({e}, length({e}) - length(substring_index({e}, '.', -1)))", d)}, substring_index({e}, '.', -1))
        when 'secret' then concat(left({e}, length({e}) - length({_value(e)})), {_drawn(_value(e), d)})
        when 'host' then array_join(transform(sequence(0, 3), j -> cast({_byte(d, "j")} % 254 + 1 as string)), '.')
        when 'phone' then concat({_lead(e)}, {_drawn(f"substr({e}, length({_lead(e)}) + 1)", d)})
        when 'card' then {_luhn(made)}
        when 'iban' then {_iban(e, made)}
        else {made} end"""
    digest = f"sha2(concat_ws('|', {_quoted(key)}, {kind(e)}, {canonical(e)}, cast({attempt} as string)), 512)"
    return f"transform(array({digest}), _d -> {body})[0]"


def _given(e: str, value: str) -> str:
    """SQL: the entity with its letters and digits replaced by those of the canonical form ``value`` of the same format."""
    plain = f"regexp_replace({value}, '[^A-Za-z0-9]', '')"
    at = f"substr({plain}, length(regexp_replace(substr({e}, 1, i + 1), '[^A-Za-z0-9]', '')), 1)"
    drawn = f"array_join(transform(split({e}, ''), (c, i) -> case when c rlike '[A-Z]' then upper({at}) when c rlike '[a-z0-9]' then {at} else c end), '')"
    return f"case {kind(e)} when 'host' then {value} when 'secret' then concat(left({e}, length({e}) - length({_value(e)})), {value}) else {drawn} end"


def _format(e: str, canon: str) -> str:
    """SQL: what all canonical forms that can stand in for each other have in common."""
    shape = f"regexp_replace(regexp_replace(regexp_replace({canon}, '[0-9]', '9'), '[a-z]', 'a'), '[A-Z]', 'A')"
    return (
        f"concat_ws('|', case {kind(e)} when 'host' then '' else {shape} end, "
        f"case {kind(e)} when 'phone' then {_lead(e)} when 'iban' then left({e}, 2) when 'mail' then lower(substring_index({e}, '.', -1)) else '' end)"
    )


def later_attempts(found: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, attempt, value) of the distinct entities whose first surrogate fails the checks.

    After ``rounds`` the entities left over make many attempts at a time, as long as that settles any. Then their
    format has no free value (or next to none): all entities of the format change places in keyed order, which is
    distinct by construction; ``value`` is the entity whose place is taken.
    """
    entities = stored(found.groupBy("kind", "canon").agg(F.min("entity").alias("entity")), "entities")
    state = entities.withColumn("attempt", F.lit(0))
    taken = entities.select("kind", F.col("canon").alias("made"))
    none = F.lit(None).cast("string").alias("value")
    for _ in range(rounds):
        tried = _made(state, key)
        first = tried.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n")).where("n > 1")
        twice = tried.join(first, ["kind", "made"]).where("canon <> first.canon").select("kind", "canon")
        again = stored(twice.unionAll(tried.join(taken, ["kind", "made"], "left_semi").select("kind", "canon")).distinct(), "failed")
        if again.isEmpty():
            return tried.where("attempt > 0").select("kind", "canon", "attempt", none)
        failed = again.withColumn("more", F.lit(1))
        state = tried.drop("made").join(failed, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more")
    settled = tried.join(again, ["kind", "canon"], "left_anti")
    left, begin, width = stored(tried.join(again, ["kind", "canon"], "left_semi").select("kind", "canon", "entity"), "left"), rounds, WIDE
    while True:
        options = _made(left.withColumn("attempt", F.explode(F.sequence(F.lit(begin), F.lit(begin + width - 1)))), key)
        free = options.join(taken, ["kind", "made"], "left_anti").join(settled, ["kind", "made"], "left_anti")
        won = free.groupBy("kind", "made").agg(F.min_by(F.struct("canon", "entity", "attempt"), F.struct("attempt", "canon")).alias("first"))
        each = won.groupBy("kind", "first.canon").agg(F.min_by(F.struct("first.entity", "first.attempt", "made"), "first.attempt").alias("x"))
        each = stored(each.select("kind", "canon", "x.entity", "x.attempt", "x.made"), "settled")
        settled = settled.unionByName(each)
        some = not each.isEmpty()
        left = stored(left.join(each, ["kind", "canon"], "left_anti"), "left")
        if left.isEmpty():
            return settled.where("attempt > 0").select("kind", "canon", "attempt", none)
        begin += width
        if not some:
            break
    shaped = entities.withColumn("format", F.expr(_format("entity", "canon")))
    full = stored(left.withColumn("format", F.expr(_format("entity", "canon"))).select("kind", "format").distinct(), "full")
    inside = shaped.join(full, ["kind", "format"])
    order = Window.partitionBy("kind", "format").orderBy(F.sha2(F.concat_ws("|", F.lit(key), "canon"), 256), "canon")
    ring = inside.withColumn("value", F.coalesce(F.lead("canon").over(order), F.first("canon").over(order)))
    ring = stored(ring.select("kind", "canon", F.lit(0).alias("attempt"), "value"), "ring")
    rest = settled.where("attempt > 0").select("kind", "canon", "attempt", none).join(ring.select("kind", "canon"), ["kind", "canon"], "left_anti")
    return rest.unionByName(ring)


def _made(state: DataFrame, key: str) -> DataFrame:
    """With the canonical form of the surrogate at ``attempt``."""
    tried = state.withColumn("made_text", F.expr(surrogate("entity", "attempt", key)))
    tried = tried.withColumn("made", F.expr(canonical("made_text"))).drop("made_text")
    return stored(tried.select("kind", "canon", "entity", "attempt", "made"), "attempts")


def replace(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """The input with every entity of ``text`` replaced by its surrogate."""
    rows = docs.withColumn("_pii_found", F.expr(f"regexp_extract_all({_column(text)}, {_quoted(ANY)}, 0)"))
    rows = stored(rows.withColumn("_pii_row", F.monotonically_increasing_id()), "documents")
    found = rows.where("size(_pii_found) > 0").select("_pii_row", F.explode("_pii_found").alias("entity"))
    found = found.select("_pii_row", F.expr(kind("entity")).alias("kind"), F.expr(canonical("entity")).alias("canon"), "entity")
    later = stored(later_attempts(found, key), "later")
    given = rows.withColumn("_pii_later", F.lit(None).cast("map<string,struct<attempt:int,value:string>>"))
    if not later.isEmpty():
        hit = found.join(later, ["kind", "canon"]).groupBy("_pii_row").agg(
            F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), F.struct("attempt", "value")))).alias("_pii_later")
        )
        given = rows.join(hit, "_pii_row", "left")
    other = f"_pii_later[concat_ws('|', {kind('e')}, {canonical('e')})]"
    attempt = f"coalesce({other}.attempt, 0)"
    new = f"transform(_pii_found, e -> if({other}.value is null, {surrogate('e', attempt, key)}, {_given('e', f'{other}.value')}))"
    gaps = f"split({_column(text)}, {_quoted(ANY)}, -1)"
    joined = f"array_join(transform({gaps}, (g, i) -> if(i < size(_pii_new), concat(g, _pii_new[i]), g)), '')"
    changed = given.withColumn("_pii_new", F.expr(new)).withColumn(text, F.expr(f"if(size(_pii_found) > 0, {joined}, {_column(text)})"))
    return changed.select(*(F.col(_column(c)) for c in docs.columns))


def _column(name: str) -> str:
    return f"`{name}`"
