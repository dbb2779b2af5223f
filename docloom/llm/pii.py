"""Personal data: keyed, type-consistent surrogates, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ensure_checkpoint_dir, once, wrapped

# What is found, tried in this order at each place.
_FREE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Госпожа"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"],
}
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.)+\p{L}{2,24}" + _END,
    "key": _FREE + r"(?:[0-9a-fA-F]{32,128}|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,200}|AKIA[A-Z0-9]{16})" + _END,
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?[\p{L}\p{N}])",
    "card": _FREE + r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})" + _END,
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})" + _END,
    "name": _FREE + r"(?:" + "|".join(TITLES["f"] + TITLES["m"]) + r")\.? \p{Lu}\p{L}{1,40}(?: \p{Lu}\p{L}{1,40})?" + _END,
}
GIVEN = {
    "f": ["Anna", "Clara", "Elena", "Eva", "Ida", "Julia", "Laura", "Lea", "Maria", "Nora", "Paula", "Sara"],
    "m": ["Adam", "Bruno", "David", "Emil", "Felix", "Hugo", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Victor"],
}
GIVEN_CYRILLIC = {
    "f": ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    "m": ["Антон", "Борис", "Виктор", "Иван", "Лев", "Михаил", "Олег", "Павел"],
}
# End of the fixed values.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Whatever has an entity has one of these; texts without them are not searched further.
HINT = r"[0-9@]|[a-fA-F]{32}|AKIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_]|[FHMSГ](?:" + "|".join(t[1:] for of in TITLES.values() for t in of) + r")[. ]"
_DIGITS = ("card", "ssn", "phone")
MOST_ATTEMPTS = 40
# From this attempt on e-mail local parts and phone numbers grow.
GROWS = 4


def _kind(raw: Column) -> Column:
    found = F.lit("phone")
    for kind in reversed([k for k in PATTERNS if k != "phone"]):
        found = F.when(raw.rlike(rf"^(?:{PATTERNS[kind]})$"), kind).otherwise(found)
    return found


def _gender(raw: Column) -> Column:
    return F.when(raw.rlike(r"^(?:" + "|".join(TITLES["f"]) + r")\b"), "f").otherwise("m")


def canonical(kind: Column, raw: Column) -> Column:
    """What all spellings of one entity share: its digits, or its lower-cased text; a name's gender and words."""
    person = F.concat(_gender(raw), F.lit("|"), F.lower(F.regexp_replace(raw, r"^\S+ ", "")))
    return (F.when(kind.isin(*_DIGITS), F.regexp_replace(raw, r"\D", "")).when(kind == "email", F.lower(raw))
            .when(kind == "name", person).otherwise(raw))


def _stream(key: str, size: Column, *parts: Column) -> Column:
    """At least ``2 * size`` keyed hex digits that depend on the parts alone."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(size / 32).cast("int")),
                                    lambda b: F.sha2(F.concat_ws("\x1f", F.lit(key), *parts, b.cast("string")), 256)), "")


def _number(stream: Column, place: Column) -> Column:
    return F.conv(F.substr(stream, 2 * place - 1, F.lit(2)), 16, 10).cast("int")


def _letters(text: Column, stream: Column, alike: str = "") -> Column:
    """Each letter and digit replaced by one of its kind and script; other characters stay."""

    def one(source: Column, drawn: Column, k: Column) -> Column:
        c, n = F.substr(source, k, F.lit(1)), _number(drawn, k)
        of = lambda letters: F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))
        hexed = F.when(c.rlike("[a-f]"), of("abcdef")).when(c.rlike("[A-F]"), of("ABCDEF")) if alike == "hex" else F.when(F.lit(False), c)
        return (hexed.when(c.rlike(r"\d"), of("0123456789"))
                .when(c.rlike(r"[а-яё]"), of("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"[А-ЯЁ]"), of("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
                .when(c.rlike(r"[α-ω]"), of("αβγδεζηθικλμνξοπρστυφχψω")).when(c.rlike(r"\p{Lu}"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .when(c.rlike(r"\p{L}"), of("abcdefghijklmnopqrstuvwxyz")).otherwise(c))

    return once(text, lambda t: once(stream, lambda s: F.array_join(F.transform(F.sequence(F.lit(1), F.length(t)), lambda k: one(t, s, k)), "")))


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo ten."""
    def add(acc: Column, k: Column) -> Column:
        d = F.substr(digits, F.length(digits) - k + 1, F.lit(1)).cast("int") * (2 - k % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def _syllables(stream: Column, many: Column, cyrillic: Column) -> Column:
    pick = lambda letters, k: F.substr(F.lit(letters), _number(stream, k) % len(letters) + 1, F.lit(1))
    one = lambda k: F.when(cyrillic, F.concat(pick("бвгдзклмнпрст", 2 * k - 1), pick("аеиоу", 2 * k))).otherwise(
        F.concat(pick("bdfghklmnprstvw", 2 * k - 1), pick("aeiou", 2 * k)))
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), many), one), ""))


def _person(key: str, canon: Column, attempt: Column) -> Column:
    """Given name of the gender, surname of the script; the surname depends on the surname alone."""
    gender, words = F.substring(canon, 1, 1), F.split(F.substr(canon, F.lit(3)), " ")
    surname, cyrillic = F.element_at(words, -1), canon.rlike("[а-яё]")
    many = F.greatest(F.lit(2), F.ceil(F.length(surname) / 2).cast("int")) + F.when(F.size(words) == 1, attempt).otherwise(0)
    family = _syllables(_stream(key, 2 * many, F.lit("surname"), surname), many, cyrillic)

    lists = {(g, c): F.array(*map(F.lit, names)) for c, of in ((False, GIVEN), (True, GIVEN_CYRILLIC)) for g, names in of.items()}

    def given(stream: Column, nth: Column) -> Column:
        pick = lambda g, c: F.element_at(lists[g, c], _number(stream, nth) % F.size(lists[g, c]) + 1)
        return F.when(cyrillic, F.when(gender == "f", pick("f", True)).otherwise(pick("m", True))).when(gender == "f", pick("f", False)).otherwise(pick("m", False))

    # One more given name every second attempt, so that no number of names is too large.
    names = once(_stream(key, F.lit(4), F.lit("given"), canon, attempt.cast("string")), lambda stream: F.array_join(
        F.transform(F.sequence(F.lit(1), F.floor(attempt / 2).cast("int") + 1), lambda nth: given(stream, nth)), " "))
    return F.when(F.size(words) == 1, family).otherwise(F.concat(names, F.lit(" "), family))


def _longer(attempt: Column) -> Column:
    """Letters or digits that a surrogate has more than its entity: one every second attempt from GROWS on."""
    return F.greatest(F.lit(0), F.floor((attempt - GROWS) / 2).cast("int") + 1)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The keyed replacement of a canonical entity: same kind and classes of characters.

    The length is the same too, except for names and for e-mail and phone entities whose
    format has too few values: those grow with the attempts.
    """
    return once(_stream(key, F.length(canon), kind, canon, attempt.cast("string")), lambda own: _drawn(key, kind, canon, attempt, own))


def _drawn(key: str, kind: Column, canon: Column, attempt: Column, own: Column) -> Column:
    """The replacement that the keyed digits ``own`` draw."""
    size = F.length(canon)
    drawn = F.concat(F.when(kind == "ssn", "").otherwise(F.substring(canon, 1, 1)),
                     _letters(F.when(kind == "ssn", canon).otherwise(F.substr(canon, F.lit(2))), own))
    checked = once(F.substr(drawn, F.lit(1), size - 1), lambda body: F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")))
    grown = lambda of: F.array_join(F.transform(F.sequence(F.lit(0), _longer(attempt)), lambda k: F.when(k == 0, "").otherwise(
        F.substr(F.lit(of), _number(more, k) % len(of) + 1, F.lit(1)))), "")
    more = _stream(key, F.lit(MOST_ATTEMPTS), F.lit("more"), kind, canon, attempt.cast("string"))
    digits = F.when((kind == "card") & (_luhn(canon) == 0), checked).when(
        (kind == "phone") & (attempt >= GROWS), F.concat(drawn, grown("0123456789"))).otherwise(drawn)
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (_number(own, k) % 254 + 1).cast("string")), ".")
    domain, tld = F.regexp_extract(canon, r"@(.*)\.[^.]*$", 1), F.regexp_extract(canon, r"\.[^.]*$", 0)
    email = F.concat(_letters(F.substring_index(canon, "@", 1), own), F.when(attempt >= GROWS, grown("abcdefghijklmnopqrstuvwxyz")).otherwise(""), F.lit("@"),
                     _letters(domain, _stream(key, size, F.lit("domain"), domain)), tld)
    secret = F.when(canon.rlike(r"^[0-9a-fA-F]+$"), _letters(canon, own, "hex")).otherwise(
        F.concat(F.regexp_extract(canon, r"^([a-z]+[-_]|AKIA)?", 0), _letters(F.regexp_replace(canon, r"^([a-z]+[-_]|AKIA)", ""), own)))
    return (F.when(kind.isin(*_DIGITS), digits).when(kind == "ip", octets).when(kind == "email", email)
            .when(kind == "name", _person(key, canon, attempt)).otherwise(secret))


def dress(kind: Column, raw: Column, made: Column) -> Column:
    """The surrogate in the raw spelling's format: separators, upper case, title."""
    return once(made, lambda m: _dressed(kind, raw, m))


def _dressed(kind: Column, raw: Column, made: Column) -> Column:
    before = lambda k: F.length(F.regexp_replace(F.substr(raw, F.lit(1), k), r"\D", ""))
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda k: F.when(
        F.substr(raw, k, F.lit(1)).rlike(r"\d"), F.substr(made, before(k), F.lit(1))).otherwise(F.substr(raw, k, F.lit(1)))), "")
    # What a surrogate has more stands behind the digits, or between local part and "@".
    extra = F.greatest(F.lit(0), F.length(made) - F.length(raw))
    numbers = F.concat(numbers, F.when(kind == "phone", F.substr(made, before(F.length(raw)) + 1, F.length(made))).otherwise(""))
    at = F.instr(raw, "@")
    place = lambda k: k + F.when(k >= at, extra).otherwise(0)
    cased = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda k: F.concat(
        F.when(k == at, F.substr(made, at, extra)).otherwise(""),
        F.when(F.substr(raw, k, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substr(made, place(k), F.lit(1)))).otherwise(F.substr(made, place(k), F.lit(1))))), "")
    return (F.when(kind.isin(*_DIGITS), numbers).when(kind == "email", cased)
            .when(kind == "name", F.concat(F.regexp_extract(raw, r"^\S+ ", 0), made)).otherwise(made))


def _found(text: Column) -> Column:
    """Entities of a text in order, as (kind, raw, canon)."""
    raws = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    typed = F.transform(raws, lambda raw: F.struct(_kind(raw).alias("kind"), raw.alias("raw")))
    return F.transform(typed, lambda e: F.struct(e["kind"].alias("kind"), e["raw"].alias("raw"), canonical(e["kind"], e["raw"]).alias("canon")))


def exceptions(entities: DataFrame, key: str) -> DataFrame:
    """Entities whose first surrogate is taken: kind, canon, attempt.

    ``entities`` holds distinct (kind, canon).  A surrogate is taken if the corpus itself has
    it as an entity of the kind, if an entity that came earlier (by canon) draws the same in
    the round, or if one settled in an earlier round has it.  The others draw again until
    all differ, each round only over those still open, cut off by a checkpoint.  Names, e-mail
    and phone entities have more values with each few attempts.  Raises ValueError if another
    kind's format has too few values for that after MOST_ATTEMPTS rounds.
    """
    ensure_checkpoint_dir(entities.sparkSession)
    real = entities.select("kind", F.col("canon").alias("made"))
    # A name's canonical form has its gender; its surrogate is compared in that form.
    shown = lambda made: F.when(F.col("kind") == "name", F.concat(F.substring("canon", 1, 1), F.lit("|"), F.lower(made))).otherwise(made)
    open_, settled, later = entities, None, None
    for attempt in range(MOST_ATTEMPTS):
        drawn = open_.select("kind", "canon", surrogate(key, F.col("kind"), F.col("canon"), F.lit(attempt)).alias("made")).withColumn("made", shown(F.col("made")))
        taken = real if settled is None else real.union(settled)
        first = drawn.groupBy("kind", "made").agg(F.min("canon").alias("canon")).join(taken, ["kind", "made"], "left_anti")
        again = drawn.join(first, ["kind", "made", "canon"], "left_anti").select("kind", "canon").checkpoint()
        if attempt:
            done = open_.join(again, ["kind", "canon"], "left_anti").select("kind", "canon", F.lit(attempt).alias("attempt"))
            later = done if later is None else later.union(done)
        if again.isEmpty():
            return later if later is not None else again.withColumn("attempt", F.lit(0))
        now = drawn.join(again, ["kind", "canon"], "left_anti").select("kind", "made").distinct()
        settled = now if settled is None else settled.union(now)
        open_ = again
    raise ValueError("an entity's format has too few values for distinct surrogates")


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced; their number goes to ``count_col`` if named.

    Equal entities, in any spelling, get equal surrogates all over the corpus and different
    ones different surrogates, none of which the corpus holds itself.  Surrogates follow from
    the key by a row's own functions; only the few that collide are kept in a table, and only
    then documents that hold one are joined to it by the XXH64 of their text.  Null texts stay
    null with 0 entities, as do texts without any; repeated rows, null ids, other columns of
    any name and empty tables pass through.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = wrapped(docs, text_col)
    text = F.col("text")
    entities = rows.select(F.explode(_found(text)).alias("e")).select("e.kind", "e.canon").distinct().checkpoint()
    odd = exceptions(entities, key).checkpoint()
    marked = rows.withColumn("found", _found(text))
    if odd.isEmpty():
        marked = marked.withColumn("tried", F.lit(None).cast("map<string,int>"))
    else:
        hit = (
            rows.select(F.xxhash64(text).alias("text_key"), F.explode(F.array_distinct(_found(text))).alias("e"))
            .select("text_key", "e.kind", "e.canon").distinct().join(odd, ["kind", "canon"])
            .groupBy("text_key").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("tried"))
        )
        marked = marked.withColumn("text_key", F.xxhash64(text)).join(hit, "text_key", "left")
    attempt = lambda e: F.coalesce(F.element_at("tried", F.concat_ws("|", e["kind"], e["canon"])), F.lit(0))
    made = F.transform("found", lambda e: dress(e["kind"], e["raw"], surrogate(key, e["kind"], e["canon"], attempt(e))))
    whole = F.array_join(F.zip_with(F.split(text, ANY, -1), made, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    many = F.greatest(F.coalesce(F.size("found"), F.lit(0)), F.lit(0))
    done = marked.select("row", F.when(many > 0, whole).otherwise(text).alias("done"), many.alias("many"))
    kept = [F.col("done").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c != count_col]
    return done.select(*kept, *([F.col("many").alias(count_col)] if count_col else []))
