"""Surrogates for personal data, with DataFrame functions only.

One regular expression finds e-mail and IP addresses, telephone, card, social security and account numbers, access keys,
passwords and tokens, street addresses, dates of birth, and names (after a title, with a listed given name, or after words
such as "my name is"). Card and account numbers count only with valid check digits. Every distinct entity, in a canonical
form that all its spellings share, gets a surrogate from a keyed hash: numbers keep their layout and stay valid of their
kind (check digits, unassigned or reserved ranges; private addresses stay private), names keep gender, script and letter
case, dates of birth move back by one keyed number of days. A name's words are entities of their own, whatever the title: the gender is
that of the listed given name, else that of the titles it has anywhere, else neutral. In a text with names, their single
words are replaced wherever else they stand with a capital.

Distinctness: surrogates of a kind that meet each other or a real entity are drawn again (with the next attempt's hash)
until none do; the smaller canonical form keeps the earlier draw. The same key and the same corpus give the same text.

Only texts with an entity are shuffled (with their entities); a fixed-size filter lets the others pass.

Defined results: null and empty texts stay; rows with one doc_id are told apart by a hash of their text; a null doc_id is
handled as a row of its own; entities are found in whole texts; all other columns stay as they are. The key is the
caller's secret and must not be empty.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, id_filter

# Titles and given names by gender, words before names, words of streets, syllables of made-up names.
TITLES = {"f": "Mrs Ms Miss Madam Lady Frau Señora Madame Mme Госпожа", "m": "Mr Sir Herr Señor Monsieur Господин", "n": "Dr Prof"}
GIVEN = {
    "f_latin": "Alice Amanda Amelia Amy Ana Andrea Angela Anita Anna Anne Barbara Beatriz Brenda Brigitte Carla Carmen Carolina Caroline Catherine Charlotte Christine Claire Claudia Cristina Daniela Deborah Diana Dolores"
    " Dorothy Elena Elizabeth Emily Emma Francesca Françoise Gabriela Grace Hannah Heidi Helen Ingrid Isabel Isabella Jane Jennifer Jessica Julia Karen Katharina Kimberly Laura Lauren Linda Lisa Lucia Margaret Maria Marie"
    " Martha Mary Megan Michelle Monika Nancy Nathalie Nicole Olivia Patricia Petra Priya Rachel Rebecca Rosa Ruth Sabine Samantha Sandra Sarah Sharon Sophie Stephanie Susan Sylvie Teresa Ursula Valentina Victoria",
    "m_latin": "Aaron Adam Alan Alejandro Andreas Andrew Anthony Antonio Benjamin Bob Brian Bruce Carlos Charles Christopher Daniel David Diego Dietrich Donald Edward Eric Fernando François Frank Frederick George Giovanni Gregory"
    " Günter Hans Harold Heinrich Henry Jack Jacob James Jason Javier Jeffrey Jean-Pierre Jerry Joe John Jonathan José Joseph Juan Jürgen Justin Karl Kenneth Kevin Klaus Larry Laurent Lukas Luis Manuel Matthew Michael Miguel"
    " Mohammed Nicolas Oliver Pablo Patrick Paul Pedro Peter Philippe Pierre Rafael Raj Raymond Richard Robert Rodrigo Ronald Samuel Scott Stefan Stephen Steven Thomas Timothy Walter William Wolfgang",
    "f_cyrillic": "Екатерина Наталья Светлана Татьяна Людмила Галина Марина Вера",
    "m_cyrillic": "Владимир Александр Дмитрий Сергей Николай Михаил Борис Григорий",
}
NEUTRAL = {"latin": "Alex Robin Jordan Taylor Morgan Casey Jamie Sascha Dominique Camille Noel Sandy Terry Dana", "cyrillic": "Саша Женя Валя Слава"}
CUES = ("my name is", "name:", "contact", "dear", "signed by", "regards,", "sincerely,", "ich heiße", "je m'appelle", "me llamo", "меня зовут")
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Way Square Place Terrace"
BORN = "born|born on|date of birth|dob|birthday|geboren am|né le|née le|nacido el|nacida el|родился|родилась"
HEADS = {"latin": "bal cor dar fel gar hol jan kel lor mar nor pel quin ros sel tor ul var wil zan", "cyrillic": "бал вол гор дан зим кар лук мар нор пол руд сав тар угл фил хар"}
TAILS = {"latin": "berg den dorf field ford gard holm kirk land ley man mont ner rick son stead ton vale well wick", "cyrillic": "анов бенко вский даев енко жинов зин инов кин лев мов нов ров сов тин хин"}
_UP = r"\p{Lu}(?:\p{L}|['’-](?=\p{L}))+"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def _any(words: list[str]) -> str:
    """The words (longest first) as a tree by first letters, so that a position that matches none is left at once."""
    def tree(rest: list[str]) -> str:
        if len(rest) == 1:
            return rest[0]
        by: dict[str, list[str]] = {}
        for w in rest:
            by.setdefault(w[:1], []).append(w[1:])
        out = [c + (tree(v) if c else "") for c, v in sorted(by.items(), reverse=True)]
        return "(?:" + "|".join(out) + ")"

    return tree(sorted(set(words), reverse=True))


_TITLE_WORDS = [w for v in TITLES.values() for w in v.split()]
_GIVEN_WORDS = [w for v in GIVEN.values() for w in v.split()]
_TITLES = _any([*_TITLE_WORDS, *[w.upper() for w in _TITLE_WORDS]])
_NAMES = _any([*_GIVEN_WORDS, *[w.upper() for w in _GIVEN_WORDS]])
_CUE = "(?i:" + "|".join(CUES) + ")"
_DATE = r"(?:\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2})"

PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+'-])[\p{L}\p{N}._%+'-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "key": _BEFORE + r"AKIA[0-9A-Z]{16}" + _AFTER,
    "secret": r"(?<=[=: \"'])(?=[0-9A-Za-z+/_-]{8})(?<=(?i:password|passwd|secret|token|api[_ -]?key)[ ]{0,2}[=:][ ]{0,2}[\"']?)[0-9A-Za-z+/_-]{8,}",
    "birth": r"(?=\d)(?<=(?i:" + BORN + r")[: ]{1,2})" + _DATE + r"(?!\d)",
    "ip": r"(?=\d)(?<![\p{L}\p{N}.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\.?[\p{L}\p{N}])",
    "iban": _BEFORE + r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?" + _AFTER,
    "ssn": r"(?=\d)(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "card": r"(?=\d)(?<![\p{L}\p{N}-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\p{L}\p{N}-])",
    "phone": r"(?=[\d+(])(?:(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|(?<=[ .-])\d{3}[ .-]|\d{3}[.-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.,+-])0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,5}(?![\p{L}\p{N}]))",
    "street": r"(?=\d)" + _BEFORE + r"\d{1,5} (?:" + _UP + " ){1,3}" + _any(STREETS.split()) + _AFTER + r"|(?=\d)" + _BEFORE + r"\d{1,4},? (?:rue|avenue|boulevard) (?:de la |de |du |des )?" + _UP
    + "|" + _BEFORE + r"\p{Lu}\p{Ll}+(?:straße|strasse|weg|platz|allee|gasse) \d{1,4}[a-z]?" + _AFTER + "|" + _BEFORE + r"(?:Calle|Avenida) (?:de la |de |del )?" + _UP + r",? \d{1,4}" + _AFTER,
    "person": _BEFORE + r"(?=\p{Lu})(?:" + _TITLES + r"\.? " + _UP + "(?: " + _UP + "){0,2}|" + _NAMES + "(?: " + _UP + "){1,2}|(?<=" + _CUE + " )" + _UP + "(?: " + _UP + "){1,2})",
}
REGEX = "|".join(PATTERNS.values())
#: A cheap test that every match passes.
HINT = r"[0-9@]|AKIA|(?i:password|passwd|secret|token|api.?key)|(?=\p{Lu})(?:" + _any([*_TITLE_WORDS, *[w.upper() for w in _TITLE_WORDS], *_GIVEN_WORDS, *[w.upper() for w in _GIVEN_WORDS]]) + r")\.? |" + _CUE


def session_key(spark: SparkSession) -> str:
    """spark.gridloom.pii.key; without that setting, a random key that holds as long as the application."""
    got = spark.conf.get("spark.gridloom.pii.key", "") or getattr(spark.sparkContext, "_gridloom_pii_key", "")
    if not got:
        got = spark.sparkContext._gridloom_pii_key = secrets.token_hex(32)
    return got


def _luhn(digits: str) -> str:
    """The sum of Luhn's rule over all digits, the last one counting once."""
    return (
        f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> case when i % 2 = 1 then"
        " case when 2 * try_cast(c as int) > 9 then 2 * try_cast(c as int) - 9 else 2 * try_cast(c as int) end else try_cast(c as int) end), 0, (a, x) -> a + x) % 10"
    )


def _mod97(text: str) -> str:
    """The remainder of an account number (country and check digits moved to the end) by 97, letters from A = 10."""
    number = f"concat_ws('', transform(split({text}, ''), c -> case when c rlike '[0-9]' then c else cast(ascii(c) - 55 as string) end))"
    return f"aggregate(split({number}, ''), 0, (a, c) -> (a * 10 + try_cast(c as int)) % 97)"


def _kind(raw: Column) -> Column:
    whole = lambda k: raw.rlike(f"^(?:{PATTERNS[k]})$")
    kind = F.when(raw.rlike("@"), "email").when(raw.rlike("^AKIA[0-9A-Z]{16}$"), "key").when(raw.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(raw.rlike(rf"^{_DATE}$"), "birth").when(whole("iban"), "iban")
    kind = kind.when(raw.rlike(r"^(?:\d{1,5},? \p{L}|.*\p{L},? \d{1,4}[a-z]?$)"), "street").when(raw.rlike(r"^[\p{L}.'’-]+ \p{Lu}"), "person")
    kind = kind.when(whole("ssn"), "ssn").when(whole("card"), "card").when(raw.rlike(r"^[+(]?(?=.*[ ().+/-])[0-9][0-9 ().+/-]+$"), "phone").otherwise("secret")
    plain = "regexp_replace(raw, '[^0-9A-Z]', '')"
    good_card = F.expr(f"{_luhn(plain)} = 0")
    good_iban = F.expr(f"{_mod97(f'concat(substr({plain}, 5), substr({plain}, 1, 4))')} = 1")
    wrong = ((kind == "card") & ~F.coalesce(good_card, F.lit(False))) | ((kind == "iban") & ~F.coalesce(good_iban, F.lit(False))) | ((kind == "birth") & F.expr(f"{_BIRTH} is null"))
    return F.when(wrong, "none").otherwise(kind)


# a date's day; the month comes first only where the second part can't be a month
_ISO = "raw rlike '^[0-9]{4}-'"
_P = "regexp_extract(raw, '^([0-9]+)[./-]([0-9]+)[./-]([0-9]+)$', {0})"
_MONTH_FIRST = f"(not {_ISO} and try_cast({_P.format(2)} as int) > 12)"
_BIRTH = "try_cast(concat_ws('-', {y}, lpad({m}, 2, '0'), lpad({d}, 2, '0')) as date)".format(
    y=f"case when {_ISO} then {_P.format(1)} else {_P.format(3)} end", m=f"case when {_MONTH_FIRST} then {_P.format(1)} else {_P.format(2)} end",
    d=f"case when {_ISO} then {_P.format(3)} when {_MONTH_FIRST} then {_P.format(2)} else {_P.format(1)} end",
)


def _moved(days: int) -> str:
    """raw, a date, that many days later in the same layout."""
    part = lambda unit, k: f"lpad(cast({unit}(date_add({_BIRTH}, {days})) as string), greatest(length({_P.format(k)}), length(cast({unit}(date_add({_BIRTH}, {days})) as string))), '0')"
    sep = "regexp_extract(raw, '([./-])', 1)"
    iso = f"cast(date_add({_BIRTH}, {days}) as string)"
    return f"case when {_ISO} then {iso} when {_MONTH_FIRST} then concat({part('month', 1)}, {sep}, {part('day', 2)}, {sep}, {part('year', 3)}) else concat({part('day', 1)}, {sep}, {part('month', 2)}, {sep}, {part('year', 3)}) end"


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, t, pos, raw, kind) for every match in (doc_id, t, text); kind none: the check digits or the date are wrong, it stays."""
    # the outer form, since the optimizer would run the expression once more to drop empty lists
    found = docs.where(F.col("text").rlike(HINT)).select("doc_id", "t", F.posexplode_outer(F.regexp_extract_all("text", F.lit(REGEX), 0)).alias("pos", "raw")).where("raw is not null")
    return found.withColumn("kind", _kind(F.col("raw")))


def _script(c: str) -> str:
    return f"case when {c} rlike '\\\\p{{IsCyrillic}}' then 'cyrillic' else 'latin' end"


def _in(c: str, words: list[str]) -> str:
    return f"{c} in ({', '.join(repr(w.lower()) for w in words)})"


def units(found: DataFrame) -> DataFrame:
    """found with title (for names) and units, an array of (kind, canon, raw, end, gender): what each match consists of."""
    head = "lower(regexp_extract(raw, '^(\\\\p{L}+)', 1))"
    titled = f"(kind = 'person' and {_in(head, _TITLE_WORDS)} and raw rlike '^\\\\p{{L}}+\\\\.? ')"
    by_title = f"case when {_in(head, TITLES['f'].split())} then 'f' when {_in(head, TITLES['m'].split())} then 'm' else '' end"
    df = found.withColumn("title", F.expr(f"case when {titled} then regexp_extract(raw, '^(\\\\p{{L}}+\\\\.? )', 1) else '' end"))
    df = df.withColumn("gender", F.expr(f"case when title <> '' then {by_title} else '' end")).withColumn("words", F.expr("split(substr(raw, length(title) + 1), ' ')"))
    # a possessive ending isn't part of the name
    df = df.withColumn("words", F.expr("transform(words, w -> struct(regexp_replace(w, '[\\'’]s$', '') as w, regexp_extract(w, '([\\'’]s)$', 1) as end))"))
    listed = {g: _in("lower(x.w)", [w for k, v in GIVEN.items() if k[0] == g for w in v.split()]) for g in "fm"}
    own = f"case when {listed['f']} then 'f' when {listed['m']} then 'm' else gender end"
    given = f"(i = 0 and (size(words) > 1 or {listed['f']} or {listed['m']}))"
    canon = F.expr(
        "case when kind in ('email', 'street') then lower(raw) when kind = 'iban' then regexp_replace(raw, '[^0-9A-Z]', '') when kind in ('phone', 'card', 'ssn') then regexp_replace(raw, '[^0-9]', '') else raw end"
    )
    # a number with and without the country code 1 is the same
    canon = F.when((F.col("kind") == "phone") & (F.length(canon) == 11) & canon.startswith("1"), F.substring(canon, 2, 10)).otherwise(canon)
    empty = F.lit("")
    single = F.array(F.struct(F.col("kind").alias("kind"), canon.alias("canon"), F.col("raw").alias("raw"), empty.alias("end"), empty.alias("gender")))
    named = F.expr(
        f"transform(words, (x, i) -> struct(concat(case when {given} then 'given_' else 'surname_' end, {_script('x.w')}) as kind, lower(x.w) as canon, x.w as raw, x.end as end,"
        f" case when {given} then {own} else '' end as gender))"
    )
    return df.withColumn("units", F.when(F.col("kind") == "person", named).otherwise(single)).drop("gender", "words")


def _pick(words: str, at: str) -> str:
    items = ", ".join(repr(w) for w in words.split())
    return f"element_at(array({items}), cast(1 + conv(substr(hex, {at}, 4), 16, 10) % {len(words.split())} as int))"


def _heads(script: str, n: str) -> str:
    """n syllables, one more every second attempt: names don't run out. The hash gives 15 (over 1e18 names), far beyond any corpus."""
    return f"concat_ws('', transform(sequence(1, least(15, cast({n} as int))), i -> {_pick(HEADS[script], 'if(i = 1, 1, 1 + 4 * i)')}))"


def _draw() -> Column:
    """The surrogate of (kind, canon, gender) at this attempt, in canonical form."""
    digits = "translate(hex, 'abcdef', '012345')"
    byte = lambda at: f"conv(substr(hex, {at}, 2), 16, 10)"
    body = f"concat(substr(canon, 1, 2), substr({digits}, 1, length(canon) - 3))"
    open_end = f"concat({body}, '0')"
    card = f"concat({body}, cast((10 - {_luhn(open_end)}) % 10 as string))"
    # ISO 13616: the country, two check digits, then the account
    upper = "translate(hex, '0123456789abcdef', 'QWERTYUPASDFGHJK')"
    lower = "translate(hex, '0123456789abcdef', 'qwertyupasdfghjk')"
    bank = f"concat_ws('', transform(split(substr(canon, 5), ''), (c, i) -> case when c rlike '[0-9]' then substr({digits}, i + 1, 1) else substr({upper}, i + 1, 1) end))"
    zero_check = f"concat({bank}, substr(canon, 1, 2), '00')"
    iban = f"concat(substr(canon, 1, 2), lpad(cast(98 - {_mod97(zero_check)} as string), 2, '0'), {bank})"
    long_hex = "concat(hex, sha2(hex, 256), sha2(concat(hex, '2'), 256), sha2(concat(hex, '3'), 256))"
    secret = (
        "concat_ws('', transform(split(canon, ''), (c, i) -> case when c rlike '[0-9]' then substr(translate({h}, 'abcdef', '012345'), i % 250 + 1, 1)"
        " when c rlike '[a-f]' then substr(translate({h}, '0123456789', 'abcdefabcd'), i % 250 + 1, 1)"
        " when c rlike '[a-z]' then substr(translate({h}, '0123456789abcdef', 'qwertyupasdfghjk'), i % 250 + 1, 1)"
        " when c rlike '[A-Z]' then substr(translate({h}, '0123456789abcdef', 'QWERTYUPASDFGHJK'), i % 250 + 1, 1) else c end))"
    ).format(h=long_hex)
    phone = (
        f"case when length(canon) = 10 and canon not like '0%' then concat(cast(2 + conv(substr(hex, 1, 2), 16, 10) % 8 as string), substr({digits}, 3, 2), case when attempt < 8 then '555' else substr({digits}, 12, 3) end, substr({digits}, 5, 4))"
        f" else concat(substr(canon, 1, 2), substr({digits}, 1, length(canon) - 2)) end"
    )
    mail = f"concat(substr({lower}, 1, 7 + attempt), case when canon rlike '^[^@]*[0-9]' then concat('.', substr({digits}, 30, 2)) else '' end, '@mail', substr({digits}, 40, 1), '.example.net')"
    # private, loopback and link-local addresses stay so; all others go to ranges that nobody has (198.18.0.0/15, then 240.0.0.0/4)
    ip = (
        f"concat_ws('.', case when canon like '10.%' or (attempt >= 6 and (canon like '192.168.%' or canon rlike '^172[.](1[6-9]|2[0-9]|3[01])[.]')) then concat('10.', {byte(1)})"
        f" when canon like '192.168.%' then concat('192.168') when canon like '169.254.%' then '169.254' when canon rlike '^172[.](1[6-9]|2[0-9]|3[01])[.]' then concat('172.', 16 + {byte(1)} % 16)"
        f" when canon like '127.%' then concat('127.', {byte(1)}) when attempt < 2 then concat('198.', 18 + {byte(1)} % 2) else concat(240 + {byte(1)} % 15, '.', {byte(9)}) end, {byte(3)}, 1 + {byte(5)} % 254)"
    )
    kinds = "|".join(w.lower() for w in STREETS.split())
    made = lambda at: f"concat({_heads('latin', 'greatest(1, attempt div 2)')}, {_pick(TAILS['latin'], at)})"
    street = (
        "concat_ws(' ', transform(split(canon, ' '), (w, i) -> case when w rlike '^[0-9]+[a-z]?,?$' then"
        f" regexp_replace(w, '^[0-9]+', concat(1 + conv(substr(hex, 3 + i, 1), 16, 10) % 9, substr({digits}, 20 + i, length(regexp_extract(w, '^([0-9]+)', 1)) - 1)))"
        f" when w rlike '^({kinds}|rue|avenue|boulevard|de|la|du|des|del|calle|avenida)$' then w"
        f" when w rlike '(straße|strasse|weg|platz|allee|gasse)$' then concat({made('5 + i')}, regexp_extract(w, '(straße|strasse|weg|platz|allee|gasse)$', 1)) else {made('5 + i')} end))"
    )
    cases = [
        ("email", mail), ("ip", ip), ("phone", phone), ("card", card), ("ssn", f"concat('9', substr({digits}, 1, 8))"), ("iban", iban),
        ("key", "concat('AKIA', substr(translate(upper(hex), '0189', 'WXYZ'), 1, 16))"), ("secret", secret), ("street", street),
    ]
    for script in ("latin", "cyrillic"):
        surname = f"concat({_heads(script, 'greatest(1, attempt div 2)')}, {_pick(TAILS[script], '5')})"
        cases.append((f"surname_{script}", surname if script == "latin" else f"concat({surname}, case when canon rlike '(ова|ева|ина|ая)$' then 'а' else '' end)"))
        one = []
        for g in "fmn":
            pool = NEUTRAL[script] if g == "n" else GIVEN[f"{g}_{script}"]
            end = {"latin": {"f": "ella", "m": "ert", "n": "ary"}, "cyrillic": {"f": "ина", "m": "ислав", "n": "ий"}}[script][g]
            one.append(f"when '{g}' then case when attempt < 3 then lower({_pick(pool, '1')}) else concat({_heads(script, 'greatest(1, attempt div 2 - 1)')}, '{end}') end")
        cases.append((f"given_{script}", f"case gender {' '.join(one)} end"))
    return F.expr(f"case kind {' '.join(f"when '{k}' then {e}" for k, e in cases)} else canon end")


def surrogates(wanted: DataFrame, key: str, scratch: Scratch, most_rounds: int = 40) -> DataFrame:
    """(kind, canon, surrogate) for the distinct (kind, canon) of (kind, canon, gender): no two alike within a kind, none a real entity of it."""
    has = lambda g: F.max((F.col("gender") == g).cast("int"))
    gender = F.when(has("f") > has("m"), "f").when(has("m") > has("f"), "m").otherwise("n")
    real = scratch.table(wanted.groupBy("kind", "canon").agg(gender.alias("gender")).withColumn("attempt", F.lit(0)))
    todo, settled = real, None

    def draw(df: DataFrame) -> DataFrame:
        text = F.concat_ws("\x1f", F.lit(key), "kind", "canon", F.col("attempt").cast("string"))
        return df.withColumn("hex", F.sha2(text.cast("binary"), 256)).withColumn("surrogate", _draw()).drop("hex")

    for _ in range(most_rounds):
        now = draw(todo).withColumn("old", F.lit(False))
        both = now if settled is None else now.unionByName(settled.withColumn("old", F.lit(True)))
        owner = both.groupBy("kind", "surrogate").agg(F.min(F.struct(~F.col("old"), "attempt", "canon")).alias("o")).select("kind", "surrogate", F.col("o.canon").alias("owner"))
        known = real.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("taken"))
        judged = scratch.table(both.join(owner, ["kind", "surrogate"]).join(known, ["kind", "surrogate"], "left"))
        good = F.col("taken").isNull() & (F.col("owner") == F.col("canon"))
        settled = judged.where(good).select("kind", "canon", "gender", "attempt", "surrogate")
        todo = judged.where(~good).select("kind", "canon", "gender", (F.col("attempt") + 1).alias("attempt"))
        if not todo.limit(1).count():
            return settled.select("kind", "canon", "surrogate")
    raise RuntimeError("surrogates kept colliding; the space of a kind is too small for its entities")


def _fit(raw: str, sur: str) -> str:
    """The surrogate's letters and digits in the layout of raw: the k-th letter or digit of raw becomes the k-th of sur, from the right."""
    plain = f"length(regexp_replace({raw}, '[^0-9A-Za-z]', ''))"
    k = f"length(regexp_replace(substr({raw}, 1, i + 1), '[^0-9A-Za-z]', '')) - {plain} + length({sur})"
    return f"concat_ws('', transform(split({raw}, ''), (c, i) -> case when c rlike '[0-9A-Za-z]' and {k} >= 1 then substr({sur}, {k}, 1) else c end))"


#: Borders between runs of letters and the rest.
_EDGE = r"(?<=[\p{L}'’-])(?![\p{L}'’-])|(?<![\p{L}'’-])(?=[\p{L}'’-])"


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text and a last column n_entities (matches replaced). The key is the caller's secret."""
    if not key:
        raise ValueError("surrogates need a key")
    scratch = Scratch(docs.sparkSession)
    own = docs.columns
    t, i, subs, names_ = "_gridloom_t", "_gridloom_i", "_gridloom_subs", "_gridloom_names"
    marked = docs.withColumn(t, F.xxhash64("text")).withColumn(i, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))))
    base = marked.select(F.col(i).alias("doc_id"), F.col(t).alias("t"), "text")
    found = scratch.table(units(entities(base)).distinct())
    each = found.select("doc_id", "t", "pos", "title", F.posexplode("units").alias("j", "u")).select("doc_id", "t", "pos", "title", "j", "u.*")
    names = surrogates(each.where("kind not in ('none', 'birth')").select("kind", "canon", "gender"), key, scratch)
    days = -400 - int.from_bytes(hashlib.sha256(key.encode()).digest()[:4], "big") % 9000
    cased = "case when raw = upper(raw) and length(raw) > 1 then upper(surrogate) else initcap(surrogate) end"
    # words of a street that the text has in small letters stay small
    street = "array_join(transform(split(surrogate, ' '), w -> case when contains(concat(' ', raw, ' '), concat(' ', w, ' ')) then w else initcap(w) end), ' ')"
    shown = (
        f"case when kind = 'none' then raw when kind = 'birth' then {_moved(days)} when kind like 'given%' or kind like 'surname%' then concat({cased}, end)"
        f" when kind = 'street' then case when raw = upper(raw) then upper(surrogate) else {street} end when kind in ('phone', 'card', 'ssn', 'iban') then {_fit('raw', 'surrogate')} else surrogate end"
    )
    made = each.join(names, ["kind", "canon"], "left").withColumn("shown", F.expr(shown))
    word = "kind like 'given%' or kind like 'surname%'"
    whole = made.groupBy("doc_id", "t", "pos").agg(
        F.array_sort(F.collect_list(F.struct("j", "shown"))).alias("parts"), F.first("title").alias("title"), F.max(F.expr("int(kind <> 'none')")).alias("real"),
        F.collect_set(F.expr(f"case when {word} then struct(canon, kind, surrogate) end")).alias("named"),
    )
    whole = whole.select("doc_id", "t", "pos", F.concat("title", F.array_join(F.transform("parts", lambda p: p["shown"]), " ")).alias("new"), "real", "named")
    lists = whole.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias(subs), F.sum("real").alias("_gridloom_n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("named")))).alias("named"))
    # given names come first in the order and win over a surname spelled alike
    first = F.expr("filter(named, (x, k) -> k = 0 or x.canon <> get(named, k - 1).canon)")
    lists = lists.withColumn("named", first).withColumn(names_, F.expr("case when size(named) > 0 then map_from_entries(transform(named, x -> struct(x.canon, x.surrogate))) end"))
    lists = scratch.table(lists.where(F.col("_gridloom_n") > 0).select(F.col("doc_id").alias(i), F.col("t").alias(t), subs, names_, "_gridloom_n"))
    maybe, surely = id_filter(lists, i)(marked, i)
    stem, end = "regexp_replace(w, '[\\'’]s$', '')", "regexp_extract(w, '([\\'’]s)$', 1)"
    new = f"element_at({names_}, lower({stem}))"
    bare = (
        f"case when {names_} is null then a else concat_ws('', transform(split(a, {_sql(_EDGE)}, -1), w -> case when w rlike '^\\\\p{{Lu}}' and {new} is not null then"
        f" concat(case when {stem} = upper({stem}) and length({stem}) > 1 then upper({new}) else initcap({new}) end, {end}) else w end)) end"
    )
    text = F.expr(f"case when {subs} is null then text else concat_ws('', zip_with(split(text, {_sql(REGEX)}, -1), {subs}, (a, b) -> concat({bare}, coalesce(b.new, '')))) end")
    done = maybe.join(lists, [i, t], "left")
    kept = [text.alias("text") if c == "text" else F.col(c) for c in own]
    return done.select(*kept, F.coalesce("_gridloom_n", F.lit(0)).cast("int").alias("n_entities")).unionByName(surely.select(*own, F.lit(0).alias("n_entities")))


def _sql(pattern: str) -> str:
    return "'" + reduce(lambda s, r: s.replace(*r), (("\\", "\\\\"), ("'", "\\'")), pattern) + "'"
