"""Personal data replaced by surrogates, with DataFrame functions only.

Every entity found is known by its kind and one or two parts, each in a canonical form that all spellings share:
a number by its digits, an e-mail address by local part and host, a name, without its title, by given and
family name. A surrogate is drawn once for each canonical form from a keyed hash and laid over every
spelling of it, digit for digit and letter for letter of the same case: coreference stays. Cards keep a valid
Luhn digit and IBANs valid check digits, phones keep their calling code, IPv4 addresses stay valid, hosts keep
their last label, names keep the title, its gender and the script. "Mr Smith" and "Mr. John Smith" share
the surrogate of the family name.

Collision checks: the surrogate of a part must differ from every real part of its kind in the corpus and from every
other surrogate. Where that fails the next attempt is drawn, until it holds for all; the table of parts is only as
large as the distinct parts.

Names are found after a title only (``_TITLES``, ``Dr`` and ``Prof``), in Latin, Cyrillic and Greek script: with degrees, initials, particles, inner
capitals, hyphens and apostrophes, and in capitals throughout. Titles, degrees and particles stay.

What a run writes and its result still reads (the searched texts, what was found, the surrogates) stays in the shared folder; all else is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import materialise, release

# What counts as an entity, in order of preference at one place.
# A run that has no bound is possessive and starts where the run before it ends, so that no text is searched twice.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b(?!\.[0-9])"
_IP6 = r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,40}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![0-9A-Za-z:])"
_CARD = r"\b[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}\b"
_SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
_LOCAL = r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b"
_TITLES = ("Mr", "Mrs", "Ms", "Miss", "Sir", "Madam", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Господин", "Госпожа", "Κύριος", "Κυρία")
_DEGREES = ("Dr", "Prof", "Professor", "Professorin", "Doktor", "Doctor", "Rev", "Hon", "Ing")
_PARTICLES = ("von", "van", "zu", "zur", "zum", "vom", "und", "de", "der", "den", "del", "della", "di", "da", "dos", "das", "du", "des", "la", "le", "ten", "ter", "af", "av", "bin", "ibn", "al", "el")
_TITLE = f"(?:{'|'.join([*_TITLES, *map(str.upper, _TITLES), 'Dr', 'Prof', 'Professor', 'DR', 'PROF'])})"
_DEGREE = rf"(?: (?:{'|'.join([*_DEGREES, *map(str.upper, _DEGREES)])})\b\.?)"
_PARTICLE = rf"(?: (?:{'|'.join(_PARTICLES)})\b)"
# No group of a number, and no word of a name, takes the start of the entity that follows it. A number that is none without
# the groups that look like another entity (+33 1 23.45.67.89) keeps them, by the last form of its pattern.
_OTHER = f"{_EMAIL}|{_IP}|{_IP6}|{_SSN}|{_LOCAL}"
# numbers with a trunk zero: an area code of three digits or more, or five pairs
_TRUNK = rf"(?<![0-9A-Za-z.,/-])(?:(?=(?:[ /-]?[0-9]){{9,12}}(?![0-9]))0[0-9]{{2,4}}[ /-][0-9]{{3,8}}(?:(?! (?:0|{_CARD}|{_OTHER}))[ -][0-9]{{3,5}})?\b|0[1-9](?:[ .-][0-9]{{2}}){{4}}\b)"
_APART = rf"(?! (?:{_OTHER}|{_TRUNK}))"
_PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?"
#: A word of a name goes on over capitals, hyphens and apostrophes inside it, but not over the s of a possessive; an initial has its point.
_WORD = rf" (?!{_EMAIL})(?!{_TITLE}\b)(?!AKIA[0-9A-Z]{{16}}\b)\p{{Lu}}(?:[\p{{L}}\p{{M}}]|-(?=\p{{L}})|['’](?=\p{{L}})(?!s\b))++(?![0-9])"
_INITIAL = r" \p{Lu}\."
PATTERNS = {
    "email": _EMAIL,
    "secret": r"\b(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)\b",
    "ip": _IP,
    "ip6": _IP6,
    "iban": rf"\b[A-Z]{{2}}[0-9]{{2}}(?:(?:[A-Z0-9]{{4}}){{3,7}}[A-Z0-9]{{0,3}}\b|(?:{_APART} ?[A-Z0-9]{{4}}){{3,7}}(?:{_APART} ?[A-Z0-9]{{1,3}})?\b|(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?\b)",
    "card": _CARD,
    "ssn": _SSN,
    "phone": rf"{_PHONE}(?:{_APART}(?! {_CARD})[ .-]?[0-9]{{2,4}}){{2,4}}\b|{_PHONE}(?:[ .-]?[0-9]{{2,4}}){{2,4}}\b|{_LOCAL}|{_TRUNK}",
    "name": rf"\b{_TITLE}\b\.?{_DEGREE}{{0,3}}(?:{_INITIAL}){{0,3}}(?:(?:{_WORD}(?:{_INITIAL}){{0,2}})?{_PARTICLE}{{0,3}}{_WORD})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Señora", "Госпожа", "Κυρία")
#: Calling codes of one and of two digits; all others have three.
CALLING = ("1", "7"), ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
GIVEN = {
    "latin m": ("Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul"),
    "latin f": ("Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helena", "Ida", "Julia", "Karin", "Lena", "Maria", "Nora", "Olga", "Paula"),
    "cyrillic m": ("Иван", "Пётр", "Павел", "Антон", "Борис", "Виктор", "Денис", "Егор"),
    "cyrillic f": ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    "greek m": ("Γιάννης", "Νίκος", "Πέτρος", "Παύλος"),
    "greek f": ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
}
SYLLABLES = {
    "latin": ("ba", "ber", "col", "dan", "del", "fen", "gar", "hol", "kin", "lan", "mar", "nor", "per", "ros", "sel", "ton"),
    "cyrillic": ("ба", "вер", "гол", "дан", "ков", "лин", "мар", "нов", "пет", "рос", "сов", "тар", "фед", "хан", "чен", "шин"),
    "greek": ("βα", "γαλ", "δαν", "ελ", "ζαν", "θεο", "καλ", "λαμ", "μαν", "νικ", "παπ", "ροδ", "σαμ", "ταν", "φαν", "χαρ"),
}
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern the whole entity fits."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def _script(c: Column) -> Column:
    return F.when(c.rlike("\\p{IsCyrillic}"), "cyrillic").when(c.rlike("\\p{IsGreek}"), "greek").otherwise("latin")


def parts_of(entity: Column, kind: Column) -> Column:
    """(kind, canon, kind2, canon2): the canonical parts of an entity; the second is null but for addresses and names."""
    words = F.split(entity, " ")
    female = F.upper(F.regexp_replace(F.get(words, F.lit(0)), "\\.", "")).isin(*map(str.upper, FEMALE))
    family = F.lower(F.element_at(words, -1))
    first_names = F.transform(F.filter(F.slice(words, 1, F.size(words) - 1), _is_given), F.lower)
    named = F.size(first_names) > 0
    given = F.when(named, F.concat_ws("|", F.array_join(first_names, " "), F.when(female, "f").otherwise("m"), family))
    mail, host = F.lower(entity), F.lower(F.substring_index(entity, "@", -1))
    number = F.when(kind == "ip6", F.lower(entity)).when(kind.isin("card", "ssn", "iban"), _bare(entity)).when(kind == "phone", F.concat(F.when(F.startswith(entity, F.lit("+")), "+").otherwise(""), _bare(entity)))
    first = F.when(kind == "email", mail).when(kind == "name", F.coalesce(given, family)).otherwise(F.coalesce(number, entity))
    kind1 = F.when((kind == "name") & ~named, "family").when(kind == "name", "given").otherwise(kind)
    kind2 = F.when(kind == "email", "host").when((kind == "name") & named, "family")
    return F.struct(kind1.alias("kind"), first.alias("canon"), kind2.alias("kind2"), F.when(kind == "email", host).when((kind == "name") & named, family).alias("canon2"))


def _is_given(word: Column) -> Column:
    """Whether a word of a name before the last is a given name or an initial: no title, degree or particle."""
    fixed = [*_TITLES, *_DEGREES, "Prof", "Dr"]
    return ~F.upper(F.regexp_replace(word, "\\.", "")).isin(*map(str.upper, fixed)) & ~word.isin(*_PARTICLES)


def _named(entity: Column, given: Column, family: Column) -> Column:
    """A name with its titles and particles as they are, the last word ``family``, a given name ``given`` and each initial a letter of it; words in
    capitals stay in capitals."""
    words = F.split(entity, " ")
    cased = lambda w, form: F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(form)).otherwise(form)
    letter = lambda i: F.concat(F.upper(F.substr(given, F.pmod(i, F.greatest(F.length(given), F.lit(1))) + 1, F.lit(1))), F.lit("."))
    told = lambda w, i: F.when(i == F.size(words) - 1, cased(w, family)).when(~_is_given(w), w).when(w.rlike("^\\p{Lu}\\.$"), letter(i)).otherwise(cased(w, given))
    return F.array_join(F.transform(words, told), " ")


def _stream(*parts: Column) -> Column:
    """256 keyed hex digits."""
    return F.concat(*[F.sha2(F.concat_ws("|", *parts, F.lit(str(i))), 512) for i in range(2)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, F.pmod(i * 2, F.lit(256)).cast("int") + 1, F.lit(2)), 16, 10).cast("int")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often and in whatever lambda it occurs."""
    return F.transform(F.array(value), use)[0]


def _same_form(canon: Column, stream: Column) -> Column:
    """Digits for digits and letters for letters of the same case; the k-th character takes the k-th byte."""

    def other(c, i):
        b = _byte(stream, i)
        put = F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string")).when(c.rlike("[a-z]"), F.substr(F.lit(LOWER), F.pmod(b, F.lit(26)) + 1, F.lit(1)))
        return put.when(c.rlike("[A-Z]"), F.substr(F.lit(UPPER), F.pmod(b, F.lit(26)) + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(canon, ""), other), "")


def luhn_sum(digits: Column) -> Column:
    """The sum of a check-digit number: every second digit from the right doubled, its digits added."""
    d = F.reverse(F.split(digits, ""))
    each = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _luhn_valid(drawn: Column, canon: Column) -> Column:
    """``drawn`` with a last digit that makes it valid where ``canon`` is."""
    body = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    last = F.pmod(F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return F.when(luhn_sum(canon) % 10 == 0, F.concat(body, last)).otherwise(drawn)


def iban_rest(bare: Column) -> Column:
    """The remainder by 97 of an IBAN's letters and digits, its first four moved to the end; 1 where it is valid."""
    moved = F.split(F.upper(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substr(bare, F.lit(1), F.lit(4)))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), lambda a, c: ((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int"))


def _iban_valid(drawn: Column, canon: Column) -> Column:
    """``drawn`` with the country of ``canon`` and, where ``canon`` has them, valid check digits."""
    rest = F.substr(drawn, F.lit(5), F.length(drawn))
    country = F.substr(canon, F.lit(1), F.lit(2))
    check = F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    return F.concat(country, F.when(iban_rest(canon) == 1, check).otherwise(F.substr(drawn, F.lit(3), F.lit(2))), rest)


def _pick(values: tuple[str, ...], b: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(b, F.lit(len(values))) + 1)


def _by_script(script: Column, values: dict[str, tuple[str, ...]], b: Column, suffix: str = "") -> Column:
    return F.when(script == "cyrillic", _pick(values["cyrillic" + suffix], b)).when(script == "greek", _pick(values["greek" + suffix], b)).otherwise(_pick(values["latin" + suffix], b))


def _syllables(script: Column, stream: Column, n: Column) -> Column:
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _by_script(script, SYLLABLES, _byte(stream, i))), "")).otherwise("")


def drawn(kind: Column, canon: Column, key: str, attempt: Column) -> Column:
    """The keyed surrogate of a canonical part. Later attempts at names are longer, so that no list of names runs out."""
    return _let(_stream(F.lit(key), kind, canon, attempt.cast("string")), lambda stream: _drawn(kind, canon, attempt, stream))


def _drawn(kind: Column, canon: Column, attempt: Column, stream: Column) -> Column:
    ip = F.concat_ws(".", (F.pmod(_byte(stream, F.lit(0)), F.lit(223)) + 1).cast("string"), *[_byte(stream, F.lit(i)).cast("string") for i in (1, 2, 3)])
    hexes = F.transform(F.split(canon, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substr(F.lit("0123456789abcdef"), F.pmod(_byte(stream, i), F.lit(16)) + 1, F.lit(1))).otherwise(c))
    ip6 = F.array_join(hexes, "")
    code = F.when(F.substring(canon, 2, 1).isin(*CALLING[0]), 1).when(F.substring(canon, 2, 2).isin(*CALLING[1]), 2).otherwise(3)
    kept = F.when(F.startswith(canon, F.lit("+")), code + 1).otherwise(0)
    phone = F.concat(F.substr(canon, F.lit(1), kept), _same_form(F.substr(canon, kept + 1, F.length(canon)), stream))
    host = F.concat(_same_form(F.regexp_replace(canon, "\\.[^.]+$", ""), stream), F.lit("."), F.substring_index(canon, ".", -1))
    local = F.concat(_same_form(F.substring_index(canon, "@", 1), stream), F.lit("@"), F.substring_index(canon, "@", -1))
    prefix = F.regexp_extract(canon, "^(AKIA|gh[pousr]_|sk-)?", 0)
    hexa = F.substr(F.repeat(stream, F.ceil(F.length(canon) / 256).cast("int")), F.lit(1), F.length(canon))
    secret = (
        F.when(canon.rlike("^[0-9a-f]+$"), hexa)
        .when(canon.rlike("^[0-9A-F]+$"), F.upper(hexa))
        .otherwise(F.concat(prefix, _same_form(F.substr(canon, F.length(prefix) + 1, F.length(canon)), stream)))
    )
    script = _script(canon)
    of = F.split(canon, "\\|")
    b0 = _byte(stream, F.lit(0))
    given = F.concat(F.when(F.get(of, F.lit(1)) == "f", _by_script(script, GIVEN, b0, " f")).otherwise(_by_script(script, GIVEN, b0, " m")), _syllables(script, stream, F.floor(attempt / 4).cast("int")))
    return (
        F.when(kind == "email", local)
        .when(kind == "host", host)
        .when(kind == "secret", secret)
        .when(kind == "ip", ip)
        .when(kind == "card", _luhn_valid(_same_form(canon, stream), canon))
        .when(kind == "ip6", ip6)
        .when(kind == "phone", phone)
        .when(kind == "iban", _iban_valid(_same_form(canon, stream), canon))
        .when(kind == "given", F.concat_ws("|", F.lower(given), F.get(of, F.lit(1)), F.get(of, F.lit(2))))
        .when(kind == "family", _syllables(script, stream, F.lit(3) + F.floor(attempt / 4).cast("int")))
        .otherwise(_same_form(canon, stream))
    )


def laid_over(spelling: Column, form: Column) -> Column:
    """``spelling`` with its letters and digits, in their order, those of ``form``, in the spelling's case."""

    def step(acc, c):
        other = F.substr(form, acc["n"] + 1, F.lit(1))
        mine = c.rlike("[A-Za-z0-9]")
        put = F.when(c.rlike("[A-Z]"), F.upper(other)).otherwise(other)
        return F.struct(F.concat(acc["s"], F.when(mine, put).otherwise(c)).alias("s"), (acc["n"] + F.when(mine, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.split(spelling, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), step)["s"]


def _assembled(entity: Column, kind: Column, first: Column, second: Column) -> Column:
    """The surrogate of one spelling from those of its parts."""
    bare = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "")
    capital = lambda c: F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.substr(c, F.lit(2), F.length(c)))
    at = F.substring_index
    # an address and its canonical form agree place by place
    mail_form = F.concat(at(first, "@", 1), F.lit("@"), second)
    mail = F.array_join(F.zip_with(F.split(entity, ""), F.split(mail_form, ""), lambda c, f: F.when(c.rlike("[A-Z]"), F.upper(f)).otherwise(f)), "")
    name = _named(entity, F.when(second.isNotNull(), capital(at(first, "|", 1))), capital(F.coalesce(second, first)))
    return F.when(kind == "email", mail).when(kind == "name", name).when(kind.isin("ip", "secret"), first).otherwise(laid_over(entity, bare(first)))


def drawn_parts(real: DataFrame, key: str, most_attempts: int = 64) -> DataFrame:
    """(kind, canon, form) of distinct canonical parts (kind, canon), free of collisions.

    Of parts that draw the same form the first, by attempt and canon, keeps it; one whose form is a real part gives
    it up. Raises if some part finds none in ``most_attempts`` draws (then more parts exist than forms).
    """
    taken = real.select(F.col("kind").alias("k"), F.col("canon").alias("form"), F.lit(True).alias("taken"))
    open_, settled, last = real.withColumn("attempt", F.lit(0)), None, None
    for _ in range(most_attempts):
        new = open_.withColumn("form", drawn(F.col("kind"), F.col("canon"), key, F.col("attempt"))).withColumn("old", F.lit(1))
        if settled is not None:
            new = new.unionByName(settled.withColumn("old", F.lit(0)))
        first = F.row_number().over(Window.partitionBy("kind", "form").orderBy("old", "canon"))
        judged = new.join(taken, (F.col("kind") == F.col("k")) & (new.form == taken.form), "left").select("kind", "canon", "attempt", new.form, "old", "taken")
        before, judged = last, materialise(judged.withColumn("good", (first == 1) & F.col("taken").isNull()), "judged")
        release(before)
        last = judged
        settled = judged.where("good").select("kind", "canon", "attempt", "form")
        bad = judged.where("not good")
        if not bad.limit(1).count():
            out = settled.select("kind", "canon", "form")
            out._table = judged._table
            return out
        open_ = bad.select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
    raise RuntimeError("no surrogates without collision are left")


def surrogates(entities: DataFrame, key: str, most_attempts: int = 64) -> DataFrame:
    """(entity, kind, canon, surrogate) of distinct ``entities`` (entity)."""
    e = entities.select("entity", kind_of(F.col("entity")).alias("kind"))
    e = materialise(e.select("entity", F.col("kind").alias("sort"), parts_of(F.col("entity"), F.col("kind")).alias("p")).select("entity", "sort", "p.*"), "entities")
    real = e.select("kind", "canon").union(e.where("kind2 is not null").select("kind2", "canon2")).distinct()
    real = materialise(real, "parts")
    forms = drawn_parts(real, key, most_attempts)
    first = forms.withColumnRenamed("form", "form1")
    second = forms.select(F.col("kind").alias("kind2"), F.col("canon").alias("canon2"), F.col("form").alias("form2"))
    both = e.join(first, ["kind", "canon"]).join(second, ["kind2", "canon2"], "left")
    out = materialise(both.select("entity", F.col("sort").alias("kind"), "canon", _assembled(F.col("entity"), F.col("sort"), F.col("form1"), F.col("form2")).alias("surrogate")), "surrogates")
    release(e, real, forms)
    return out


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def with_surrogates(docs: DataFrame, key: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, n_entities, kinds): every document with its entities replaced; ``kinds`` counts them.

    An empty table gives an empty one. Null texts stay null and texts without entities stay as they are, with 0 entities. Texts are searched once: what is found
    is written beside each text, and only texts with entities are shuffled, by their MD5 digest, so that copies are
    done once. Null ids and repeated rows keep their rows. Other columns are ignored.
    """
    d = docs.select(docs[id].alias("id"), docs[text].cast("string").alias("text"))
    d = d.withColumn("entities", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    d = materialise(d.withColumn("text_md5", F.when(F.size("entities") > 0, F.md5("text"))), "searched")
    plain, hit = d.where("text_md5 is null").select("id", "text"), d.where("text_md5 is not null")
    found = hit.select("text_md5", F.posexplode("entities").alias("place", "entity"))
    found = materialise(found.dropDuplicates(["text_md5", "place"]), "found")
    table = surrogates(found.select("entity").distinct(), key)
    by_text = found.join(table, "entity").groupBy("text_md5").agg(F.sort_array(F.collect_list(F.struct("place", "surrogate", "kind"))).alias("s"))
    joined = hit.drop("entities").join(by_text, "text_md5")
    pieces = F.split("text", ANY, -1)
    put = F.transform(F.arrays_zip(pieces.alias("piece"), F.col("s").alias("s")), lambda x: F.concat(x["piece"], F.coalesce(x["s"]["surrogate"], F.lit(""))))
    kinds = F.map_from_arrays(F.array(*[F.lit(k) for k in PATTERNS]), F.array(*[F.size(F.filter("s", _is_kind(k))) for k in PATTERNS]))
    none = F.map_from_arrays(F.array(*[F.lit(k) for k in PATTERNS]), F.array(*[F.lit(0) for _ in PATTERNS]))
    done = joined.select("id", F.array_join(put, "").alias("text"), F.size("s").cast("long").alias("n_entities"), kinds.alias("kinds"))
    return plain.select("id", "text", F.lit(0).cast("long").alias("n_entities"), none.alias("kinds")).union(done)
