"""PII surrogates: keyed replacements of detected entities; DataFrame operations only.

Entities are e-mail addresses, telephone numbers, payment cards, IBANs, IPv4 and IPv6 addresses, social security numbers, secrets
(passwords, tokens, access and private keys) and names. Each distinct entity gets a surrogate of its type: letters become letters of
the same script and case, digits digits, marks stay; hexadecimal secrets stay hexadecimal; a card keeps its Luhn remainder, an IBAN
its country and valid check digits, an IPv4 address its four parts. The surrogate's letters come from a digest of key, type,
attempt and normal form, so one entity has one surrogate in all documents (spellings of a telephone or card
number, and of an address in other cases, share theirs, each in its own format).

Names are found after a form of address; a given name and a surname are entities of their own, so "Mr. John Smith", "Mr. Smith" and
"Mrs. Smith" agree in the surname everywhere, and in a text with a form of address each word of the name is replaced wherever
it stands alone, with or without the form. Given names get names of the gender that the form says: of a list first, then formed of syllables.

Collisions are looked for over all entities: a surrogate that another entity got first, or that is itself an
entity of the corpus, is drawn again with the next attempt until none is left. After every ATTEMPTS attempts it is drawn one character longer
(but for IP addresses, which are never so many), so that short entities cannot use up their surrogates. What has no letter or digit
(blank forms, masked values) is no secret.

Only documents with an entity are shuffled: each leaves one row for each of its entities (its text stays with the
first) that meets the entity's surrogate, and is put together again by row. Entities that stand in many rows come from a
broadcast table of bounded size; distinct ones are formed by partial aggregation first.

Defined results: null and empty texts have no entities; rows that repeat are each rewritten, alike; rows without doc_id
too; all other columns stay, whatever their names (n_chars follows the text where it is there); where the table has a column
n_entities, the new one is n_entities_found.
"""

from __future__ import annotations

from functools import reduce
from unicodedata import category

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, meet_hot, stash, table

KEY = "surrogates-1"
#: Attempts after which a stubborn collision's surrogate is drawn a character longer, and so on.
ATTEMPTS = 8

_HEAD = r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|secret|private)[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
_PRIVATE = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
_HEX = "[0-9A-Fa-f]{1,4}"
#: What an entity of each type looks like. The first that matches a found string names its type.
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    # After a colon a bare word is a secret only if it has a digit.
    "secret": _HEAD + r"(?:(?<=[=\"']\s{0,3})|(?=[^\s\"'<>,;]{0,200}[0-9]))(?=[^\s\"'<>,;A-Za-z0-9]{0,200}[A-Za-z0-9])[^\s\"'<>,;]{6,}|\b(?i:bearer)\s{1,3}(?=[A-Za-z._~+/\-]{0,200}[0-9])[A-Za-z0-9._~+/\-]{16,}|" + _PRIVATE + r"[A-Za-z0-9+/=\s]{20,}",
    "access": r"\b(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abps]-[A-Za-z0-9\-]{10,}|glpat-[A-Za-z0-9_\-]{16,}|sk-[A-Za-z0-9_\-]{20,})\b",
    "iban": r"\b[A-Z]{2}[0-9]{2} ?(?:[A-Z]{4} ?)?(?:[0-9]{4} ?){2,6}[0-9]{1,4}\b",
    "card": r"(?<![0-9])(?:[0-9]{4}[ \-]?){3}[0-9]{4}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5}(?![0-9])",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:])(?=[A-Fa-f:]{{0,8}}[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}[ .\-]?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){2,3}(?![0-9])",
}
ENTITY = "|".join(TYPES.values())
#: Forms of address, and capitalised words that begin a sentence and are no part of the name before.
_TITLE = r"(?:\bMr\.|\bMrs\.|\bMs\.|\bHerr\b|\bFrau\b|\bMonsieur\b|\bMadame\b|\bSeñora?\b)"
_NO_NAME = "The|A|An|And|But|Or|He|She|It|They|We|You|In|On|At|Of|To|For|Der|Die|Das|Und|Er|Sie|Es|Wir|Le|La|Les|Un|Une|Et|Il|Elle|El|Los|Las|Una|Ella"
_WORD = r"\p{Lu}[\p{L}\p{M}'’\-]*[\p{L}\p{M}]"
NAME = rf"{_TITLE} {_WORD}(?: (?!(?:{_NO_NAME})\b){_WORD})?"
#: What any entity has: lets most texts go after one quick look.
MAYBE = r"[0-9@]|[=:]|A[KS]IA|gh[pousr]_|xox[abps]-|glpat-|sk-|PRIVATE KEY|Mr|Ms\.|Herr|Frau|Monsieur|Madame|Señor"
_SECRET_HEAD = rf"^(?:{_HEAD}|(?i:bearer)\s{{1,3}}|{_PRIVATE})"
#: Given names by gender.
WOMEN = ["Anna", "Clara", "Elena", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera", "Olga", "Lena", "Rosa", "Emma", "Alice"]
MEN = ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Karl", "Leon", "Max", "Oscar", "Paul", "Robert", "Simon", "Victor"]


def _script(first: str, last: str) -> str:
    """The letters of a range that are not upper case, 200 at most."""
    return "".join(c for c in map(chr, range(ord(first), ord(last) + 1)) if category(c) in ("Ll", "Lo"))[:200]


#: Letters of a script from which one letter is drawn, by its range.
SCRIPTS = {f"{a}-{b}": _script(a, b) for a, b in ("az", "ßÿ", "āſ", "αω", "ая", "ѐџ", "աֆ", "את", "ءي", "अह", "กฮ", "აჰ", "ぁん", "ァヶ", "一鿿", "가힣")}


def _let(value: Column, f) -> Column:
    """f of a value that is formed once, however often and in whatever lambda f reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _drawn(stream: Column, i: Column) -> Column:
    """The ith number below 65536 of a stream of hexadecimal digits."""
    return F.conv(F.substr(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _stream(kind: Column, norm: Column, attempt: Column) -> Column:
    """Enough hexadecimal digits for the normal form: digests of key, type, attempt, form and a number."""
    blocks = F.sequence(F.lit(0), F.ceil(F.length(norm) / 16).cast("int"))
    return F.array_join(F.transform(blocks, lambda k: F.sha2(F.concat_ws("|", F.lit(KEY), kind, attempt.cast("string"), k.cast("string"), norm).cast("binary"), 256)), "")


def _letters(norm: Column, stream: Column, hexadecimal: Column, digits_only_from: Column) -> Column:
    """Each letter and digit of norm from there on drawn anew within its script; other characters stay."""

    def one(i: Column) -> Column:
        c, n = F.substr(norm, i + 1, F.lit(1)), _drawn(stream, i)
        pick = lambda letters: F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))
        out = F.when(i < digits_only_from, c).when(c.rlike("[0-9]"), (n % 10).cast("string")).when(hexadecimal & c.rlike("[a-f]"), pick("abcdef"))
        for span, letters in SCRIPTS.items():
            out = out.when(c.rlike(f"[{span}]"), pick(letters))
        return out.when(c.rlike(r"\p{L}"), pick(SCRIPTS["a-z"])).otherwise(c)  # of a script that is not listed

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(norm) - 1), one), "")


def _luhn(digits: Column, n: Column) -> Column:
    """Luhn sum of the first n digits of a number that has as many as digits."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def type_of(found: Column) -> Column:
    names = list(TYPES.items())
    return reduce(lambda out, t: out.when(found.rlike(f"^(?:{t[1]})$"), t[0]), names[1:], F.when(found.rlike(f"^(?:{names[0][1]})$"), names[0][0])).otherwise("secret")


def normal_form(kind: Column, found: Column) -> Column:
    """What spellings of one entity share."""
    return (
        F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(found, "[^0-9]", ""))
        .when(kind.isin("email", "ipv6"), F.lower(found))
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .when(kind == "secret", F.regexp_replace(found, _SECRET_HEAD, ""))
        .otherwise(found)
    )


def surrogate(kind: Column, norm: Column, attempt: Column) -> Column:
    """The attempt's surrogate of a normal form."""
    more = F.when(kind.isin("ipv4", "ipv6"), 0).otherwise(F.floor(attempt / ATTEMPTS)).cast("int")
    longer = (
        F.when(kind == "email", F.concat(F.repeat(F.lit("a"), more), norm)).when(kind.isin("card", "phone", "ssn", "iban"), F.concat(norm, F.repeat(F.lit("0"), more)))
        .when(kind == "access", F.concat(norm, F.repeat(F.lit("A"), more))).otherwise(F.concat(norm, F.repeat(F.lit("a"), more)))
    )
    return _let(F.struct(longer.alias("norm"), _stream(kind, longer, attempt).alias("stream"), more.alias("more")), lambda x: _of_stream(kind, x["norm"], x["stream"], x["more"], attempt))


def _of_stream(kind: Column, norm: Column, stream: Column, more: Column, attempt: Column) -> Column:
    lower, n = F.lower(norm), F.length(norm)
    # A telephone number keeps the country's code, an access key its first four letters, an address its last label.
    head = F.when((kind == "phone") & (n - more > 10), n - more - 10).when(kind.isin("access", "iban"), 4).otherwise(0)
    letters = _letters(lower, stream, (kind == "ipv6") | (kind == "secret") & lower.rlike("^[0-9a-f]+$"), head)

    def cased(drawn: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.substr(norm, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substr(drawn, i + 1, F.lit(1)))).otherwise(F.substr(drawn, i + 1, F.lit(1)))), "")

    def card(drawn: Column) -> Column:
        """The last digit makes the sum's remainder what it was."""
        part = F.substr(drawn, F.lit(1), n - 1)
        return F.concat(part, F.pmod(_luhn(norm, n) - _luhn(F.concat(part, F.lit("0")), n - 1), F.lit(10)).cast("string"))

    def given() -> Column:
        """Of the list at the first attempt; after that of two syllables and more, with the gender's ending."""
        woman = kind == "given-w"
        pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), _drawn(stream, F.lit(k) if isinstance(k, int) else k) % len(names) + 1)
        formed = F.array_join(F.transform(F.sequence(F.lit(1), F.least(more, F.lit(12)) + 2), lambda i: F.concat(pick(list("bcdfghjklmnprstvwz"), 2 * i), pick(list("aeiou"), 2 * i + 1))), "")
        return F.when(attempt > 0, F.initcap(F.concat(formed, F.when(woman, "na").otherwise("rt")))).when(woman, pick(WOMEN, 0)).otherwise(pick(MEN, 0))

    def iban(own: Column) -> Column:
        """The country stays; the check digits are those that make the number valid."""
        value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        whole = F.concat(F.substr(own, F.lit(5)), F.substr(norm, F.lit(1), F.lit(2)), F.lit("00"))
        rest = F.aggregate(F.filter(F.split(whole, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.pmod(r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)).cast("int"))
        return F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(own, F.lit(5)))

    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_drawn(stream, i) % 254 + 1).cast("string")), ".")
    email = lambda own: F.concat(F.regexp_extract(own, r"^(.*\.)[^.]*$", 1), F.regexp_extract(norm, r"([^.]*)$", 1))
    of_case = lambda f: _let(cased(letters), f)
    return (
        F.when(kind == "card", _let(letters, card)).when(kind == "ipv4", octets).when(kind == "email", of_case(email)).when(kind.startswith("given"), given()).when(kind == "iban", of_case(iban)).otherwise(_let(letters, cased))
    )


def formatted(kind: Column, found: Column, drawn: Column) -> Column:
    """The surrogate in the format of what was found."""
    at = lambda i: F.length(F.regexp_replace(F.substr(found, F.lit(1), i + 1), "[^0-9A-Z]", ""))
    places = F.sequence(F.lit(0), F.length(found) - 1)
    c = lambda i: F.substr(found, i + 1, F.lit(1))
    digits = F.array_join(F.transform(places, lambda i: F.when(c(i).rlike("[0-9A-Z]"), F.substr(drawn, at(i), F.lit(1))).otherwise(c(i))), "")
    cases = F.array_join(F.transform(places, lambda i: F.when(c(i).rlike(r"\p{Lu}"), F.upper(F.substr(drawn, i + 1, F.lit(1)))).otherwise(F.substr(drawn, i + 1, F.lit(1)))), "")
    rest = lambda n: F.substr(drawn, n + 1, F.lit(1 << 20))  # noqa: E731  (what was drawn longer)
    return F.when(kind.isin("card", "phone", "ssn", "iban"), F.concat(digits, rest(at(F.length(found))))).when(kind.isin("email", "ipv6"), F.concat(cases, rest(F.length(found)))).when(kind == "secret", F.concat(F.regexp_extract(found, _SECRET_HEAD, 0), drawn)).otherwise(drawn)


def names_in(text: Column) -> Column:
    """array of struct(word, kind): the words of the names after forms of address."""

    def parts(name: Column) -> Column:
        w = F.split(name, " ")
        given = F.when(w[0].isin("Mrs.", "Ms.", "Frau", "Madame", "Señora"), "given-w").otherwise("given-m")
        surname = F.struct(F.element_at(w, -1).alias("word"), F.lit("surname").alias("kind"))
        return F.when(F.size(w) == 3, F.array(F.struct(w[1].alias("word"), given.alias("kind")), surname)).otherwise(F.array(surname))

    return F.when(text.rlike(_TITLE), F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({NAME})"), 1), parts)))).otherwise(F.array().cast("array<struct<word:string,kind:string>>"))


def pattern_of(names: Column) -> Column:
    """What is looked for in a text with these names: entities, and the words of the names, the longest first."""
    words = F.transform(F.array_sort(F.array_distinct(F.transform(names, lambda x: F.struct((-F.length(x["word"])).alias("n"), x["word"].alias("w"))))), lambda x: x["w"])
    return F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{M}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{M}])"))


def found_in(text: Column, names: Column) -> Column:
    """All entities of a text, in order; most texts have none and are passed over quickly."""
    plain = F.regexp_extract_all(text, F.lit(f"({ENTITY})"), 1)
    named = F.regexp_extract_all(text, F.concat(F.lit("("), pattern_of(names), F.lit(")")), 1)
    return F.when(F.coalesce(text.rlike(MAYBE), F.lit(False)), F.when(F.size(names) > 0, named).otherwise(plain)).otherwise(F.array().cast("array<string>"))


def surrogates(entities: DataFrame) -> DataFrame:
    """_ki, _no, _su: a surrogate of its own for each distinct entity (_ki, _no); collisions are drawn again."""
    # An entity's draws do not depend on the others, so a collision's loser is the later one in order; it draws again.
    spark = entities.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo, done, attempt = entities.withColumn("_at", F.lit(0)), None, 0
    while True:
        # Few bytes but much work: dealt out to as many tasks as a shuffle has.
        drawn = stash(todo.repartition(parts, "_ki", "_no").select("_ki", "_no", surrogate(F.col("_ki"), F.col("_no"), F.col("_at")).alias("_su")), "drawn")
        taken = [entities.select("_ki", F.col("_no").alias("_su"), F.lit(True).alias("_old"), F.lit(None).cast("string").alias("_no"))]
        if done is not None:
            taken.append(done.select("_ki", "_su", F.lit(True).alias("_old"), F.lit(None).cast("string").alias("_no")))
        whole = reduce(DataFrame.unionByName, taken, drawn.select("_ki", "_su", F.lit(False).alias("_old"), "_no"))
        first = whole.groupBy(F.col("_ki").alias("_k2"), F.col("_su").alias("_s2")).agg(F.min("_no").alias("_n2"), F.max("_old").alias("_o2"))
        judged = stash(
            drawn.join(first, (F.col("_ki") == F.col("_k2")) & (F.col("_su") == F.col("_s2"))).select("_ki", "_no", "_su", (~F.col("_o2") & (F.col("_no") == F.col("_n2"))).alias("_ok")), "surrogates"
        )
        good = judged.where("_ok").select("_ki", "_no", "_su")
        done = good if done is None else done.unionByName(good)
        bad = judged.where("not _ok")
        if bad.isEmpty():
            return done
        attempt += 1
        todo = bad.select("_ki", "_no", F.lit(attempt).alias("_at"))


def rewrite(docs: DataFrame) -> DataFrame:
    """docs with every entity in text replaced, and n_entities."""
    names, spark = docs.columns, docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    looked = docs.select(F.struct(*names).alias("_pa"), names_in(F.col("text")).alias("_na")).withColumn("_en", found_in(F.col("_pa.text"), F.col("_na")))
    kind = lambda e: F.array_max(F.transform(F.filter("_na", lambda x: x["word"] == e), lambda x: x["kind"]))  # noqa: E731  (a surname before a given name)
    occurrence = F.transform("_en", lambda e: F.struct(e.alias("fo"), kind(e).alias("kw")))
    scanned = stash(looked.where(F.size("_en") > 0).select("_pa", "_na", occurrence.alias("_en"), F.monotonically_increasing_id().alias("_ro")), "pii")
    # Joins go by what was found and, of a word of a name, its kind.
    key = lambda fo, kw: F.concat(F.coalesce(kw, F.lit("")), F.lit("|"), fo)
    found = scanned.select("_ro", F.explode("_en").alias("_oc")).groupBy("_oc.fo", "_oc.kw").agg(F.count(F.lit(1)).alias("_n"))
    found = found.select(F.col("fo").alias("_fo"), key(F.col("fo"), F.col("kw")).alias("_key"), F.coalesce("kw", type_of(F.col("fo"))).alias("_ki"), "_n")
    found = stash(found.withColumn("_no", normal_form(F.col("_ki"), F.col("_fo"))), "found")
    own = surrogates(stash(found.select("_ki", "_no").distinct(), "entities"))
    spelled = found.join(own, ["_ki", "_no"]).repartition(parts, "_key").select("_key", "_n", formatted(F.col("_ki"), F.col("_fo"), F.col("_su")).alias("_value"))
    spelled = stash(spelled, "spelled")
    total = spelled.agg(F.sum("_n")).first()[0] or 0
    # One row for each entity of a text; the text and the other columns go with the first.
    rows = scanned.select("_ro", F.posexplode("_en").alias("_po", "_oc"), "_pa", "_na").select("_ro", "_po", key(F.col("_oc.fo"), F.col("_oc.kw")).alias("_ke"), F.when(F.col("_po") == 0, F.struct("_pa", "_na")).alias("_pa"))
    met = meet_hot(rows, F.col("_ke"), F.xxhash64("_ro", "_po"), spelled, total)
    whole = met.groupBy("_ro").agg(F.sort_array(F.collect_list(F.struct("_po", "_value"))).alias("_li"), F.first("_pa", ignorenulls=True).alias("_pa"))
    whole = whole.select("_li", "_pa._pa", "_pa._na")
    text = F.col("_pa.text")
    gaps = F.when(F.size("_na") > 0, F.split(text, pattern_of(F.col("_na")), -1)).otherwise(F.split(text, ENTITY, -1))
    new = F.array_join(F.flatten(F.zip_with(gaps, F.transform("_li", lambda x: x["_value"]), lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    changed = whole.select(new.alias("_ne"), "_pa", F.size("_li").alias("_co"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("_ne").alias("text")
        if name == "n_chars":
            return F.length("_ne").cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col("_pa")[name].alias(name)

    count = fresh("n_entities", names)
    kept = looked.where(F.size("_en") == 0).select("_pa.*", F.lit(0).alias(count))
    return kept.unionByName(changed.select(*map(column, names), F.col("_co").alias(count)))


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_entities of every document."""
    return rewrite(table(spark, sf_dir, "documents").select("doc_id", "text"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates in place of personal data and secrets."""
    return rewrite(docs).select(*docs.columns)
