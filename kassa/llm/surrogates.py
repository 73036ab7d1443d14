"""PII surrogates, native Spark SQL: detected entities get keyed replacements.

Detection is one regular expression; a mention is cut into parts (kind, text).
The distinct parts of the corpus form the entity table: each (kind, canonical
value) gets one surrogate, derived from a secret key with SHA-256, so the same
entity has the same surrogate in every document (coreference), in the format of
the mention: digits fill the mention's own punctuation, letters keep their
class and case, card numbers keep a valid check digit, IPv4 stays IPv4, names
keep their script and the gender of the title. A name found after a title is
replaced wherever the document has it again without one. A surrogate that another entity
already has, or that is itself an entity of the corpus, is drawn again (only that one); names
and the local parts of e-mails grow with the attempts, and what a full digit
format leaves after the draws gets the free values by rank.

Scale: texts without an entity pass straight through; the others join their
replaced mentions by a digest of the mention list, so copies of a document share
the work, rows without or with equal ids are no special case, and a text of many
mentions is as many narrow rows. The entity table
has one row per distinct entity; of it, only full formats and the row counts of
256 buckets are ever collected.

Edge cases: a null text stays null, an empty one empty; a mention that repeats
is replaced every time; other columns pass through untouched; columns that
clash with the working names are renamed for the time of the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassa.llm.components import stored

DEFAULT_KEY = "change-this-key"
MOST_ROUNDS = 40
ENTITIES_PER_FILE = 100_000

MALE = ("Mr", "Sir", "Herr", "Monsieur", "monsieur", "Señor", "señor", "Sr", "Don", "don", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "madame", "Mademoiselle", "Mme", "Mlle", "Señora", "señora",
          "Señorita", "señorita", "Sra", "Srta", "Doña", "doña", "Dra", "Profesora", "госпожа", "κυρία")
NEUTRAL = ("Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Profesor", "Mx", "доктор", "профессор")

_TITLES = "|".join(MALE + FEMALE + NEUTRAL)
#: A name; no title, and without a genitive ('s).
_WORD = r"\p{Lu}(?:(?:['’](?![sS](?!\p{L})))?\p{L})+"
_NAME_TOKEN = rf"(?!(?:{_TITLES})(?!\p{{L}})){_WORD}(?:-{_WORD})?"
_TITLE = rf"(?:(?:{_TITLES})\.? )+"
_MAIL = r"\p{L}\p{M}\p{N}"

#: A digit of a phone number with what may part it from the one before: groups
#: have two digits or more, but for the first after a country code.
_DIGIT = r"(?: ?\((?=[0-9]{2})|\)[ ./-]?(?=[0-9]{2})|[ ./-](?=[0-9]{2}))?[0-9]"
_FIRST = r"(?: ?\(0\) ?)?(?: ?\(|[ ./-])?[0-9]"
_NO_DIGIT_BEFORE = r"(?<![0-9])"
_ALONE = r"(?<![0-9A-Za-z])(?<![0-9][.,/-])"
_PHONES = (
    # After a country code: North America, France, Spain, Britain, Germany, others.
    rf"(?:{_NO_DIGIT_BEFORE}\+|{_ALONE}00 ?)(?:1{_FIRST}(?:{_DIGIT}){{9}}|3[34]{_FIRST}(?:{_DIGIT}){{8}}"
    rf"|44{_FIRST}(?:{_DIGIT}){{8,9}}|49{_FIRST}(?:{_DIGIT}){{5,10}})(?![0-9])",
    rf"{_NO_DIGIT_BEFORE}\+[2-9]{_FIRST}(?:{_DIGIT}){{6,12}}(?![0-9])",
    # French pairs, and ten or eleven digits with the trunk zero in one.
    rf"{_ALONE}0[1-9](?:(?: [0-9]{{2}}){{4}}|(?:\.[0-9]{{2}}){{4}}|(?:-[0-9]{{2}}){{4}}|[0-9]{{8,9}})(?![0-9])",
    # Spanish mobile and landline groups.
    rf"{_ALONE}[6-9][0-9]{{2}}(?:(?: [0-9]{{2}}){{3}}|(?:\.[0-9]{{2}}){{3}}|(?:-[0-9]{{2}}){{3}})(?![0-9])",
    rf"{_ALONE}[89][0-9] [0-9]{{3}} [0-9]{{2}} [0-9]{{2}}(?![0-9])",
    # A German or British area code with the trunk zero, then six to eight digits.
    rf"{_ALONE}(?:\(0[1-9][0-9]{{1,4}}\) ?|0[1-9][0-9]{{1,4}}(?: ?[/-] ?|[ .]))[0-9](?:(?:[ .-](?=[0-9]{{2}}))?[0-9]){{5,7}}(?![0-9])",
)
PATTERNS = {
    "email": rf"(?<![{_MAIL}._%+-])[{_MAIL}._%+-]{{1,64}}+@[{_MAIL}](?:[{_MAIL}-]{{0,62}}\.)+\p{{L}}[\p{{L}}\p{{M}}]{{1,23}}(?![{_MAIL}])",
    # A secret ends where its characters end, however long it is: a part of one is a leak.
    "secret": (r"(?<=\b(?i:token|secret|password|passwd|api_key|apikey)['\"]?\s{0,2}[:=]\s{0,2}['\"]?)"
               r"[A-Za-z0-9_+/-]{16,}+(?:\.[A-Za-z0-9_+/-]++)*+={0,2}+"
               r"|(?<=\b(?:AKIA|ASIA))[0-9A-Z]{16,}+|(?<=\bgh[pousr]_)[A-Za-z0-9]{36,}+|(?<=\bsk-)[A-Za-z0-9_-]{20,}+"
               r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{13,}+(?:\.[A-Za-z0-9_-]++)++"),
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": (r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])"),
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": (r"(?=[+(0-9])(?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))(?:" + "|".join(_PHONES) + "|"
              r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
              r"|(?<![0-9])\+[0-9]{8,15}(?![0-9]))"),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": rf"(?<!\p{{L}}){_TITLE}{_NAME_TOKEN}(?: {_NAME_TOKEN})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must hold to have any mention: cheap to look for.
HINT = rf"[0-9@]|(?i:secret|token|password|passwd|api_?key)|(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}"
_DIGIT_KINDS = ("card", "phone", "ssn")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"

SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va".split(),
    "cyrillic": "ба бе бо да де до ва ве га го ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то фа".split(),
    "greek": "βα βε βο δα δε δο φα φε γα γο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το ζα".split(),
}
ENDINGS = {
    ("given_m", "latin"): "rick bert win mund".split(), ("given_f", "latin"): "lina ria nette della".split(),
    ("given_m", "cyrillic"): "слав мир дан рий".split(), ("given_f", "cyrillic"): "лина рия слава дана".split(),
    ("given_m", "greek"): "νος ρης δης μος".split(), ("given_f", "greek"): "νια ρια λια να".split(),
    ("given_n", "latin"): "rin lex kim ari".split(), ("given_n", "cyrillic"): "ша ня жа ля".split(),
    ("given_n", "greek"): "ιν αξ ις υς".split(),
    ("surname", "latin"): "son ler man ton".split(), ("surname", "cyrillic"): "нко дзе рук нич".split(),
    ("surname", "greek"): "δου κου λου που".split(),
}


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def find_mentions(text: Column) -> Column:
    """The mentions of a text in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def _kind(mention: Column) -> Column:
    """The first pattern that the whole mention matches (a secret, which is
    found by what stands before it, is what no other pattern is)."""
    out = F.lit("secret")
    for name in reversed([n for n in PATTERNS if n != "secret"]):
        out = F.when(mention.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def _script(token: Column) -> Column:
    return (F.when(token.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic"))
            .when(token.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin")))


def _part(kind: Column, text: Column, canon: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("piece"), canon.alias("canon"))


def _parts(mention: Column) -> Column:
    """A mention as parts (kind, piece, canon); literal parts stay."""
    kind = _kind(mention)
    literal = lambda c: _part(F.lit("literal"), c, F.lit(""))
    title = F.regexp_extract(mention, f"^{_TITLE}", 0)
    names = F.split(F.substring(mention, F.length(title) + 1, F.length(mention)), " ")
    last, first = F.element_at(names, -1), F.element_at(names, 1)
    among = lambda titles: title.rlike(rf"(?<!\p{{L}})(?:{'|'.join(titles)})(?!\p{{L}})")
    sex = (F.when(among(FEMALE), F.lit("given_f")).when(among(MALE), F.lit("given_m")).otherwise(F.lit("given_n")))
    surname = _part(F.concat_ws(":", F.lit("surname"), _script(last)), last, F.lower(last))
    given = _part(F.concat_ws(":", sex, _script(first)), first, F.lower(first))
    named = F.when(F.size(names) > 1, F.array(literal(title), given, literal(F.lit(" ")), surname)) \
        .otherwise(F.array(literal(title), surname))
    canon = (F.when(kind.isin(*_DIGIT_KINDS), F.regexp_replace(mention, "[^0-9]", ""))
             .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
             .when(kind == "email", F.lower(mention)).otherwise(mention))
    return F.when(kind == "name", named).otherwise(F.array(_part(kind, mention, canon)))


# --- surrogates -----------------------------------------------------------------

def _seed(key: str, *values: Column) -> Column:
    """A keyed seed: what all draws of one value start from."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *values).cast("binary"), 256)


def _draw(seed: Column, i: Column, n: int) -> Column:
    """The i-th number below n of a seed: four hex digits of its block of 16
    (so a draw costs one hash, however long the value is)."""
    block = F.sha2(F.concat_ws("\x1f", seed, F.floor(i / 16).cast("string")).cast("binary"), 256)
    return F.conv(F.substring(block, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int") % n


def _same_class(value: Column, digest: Column, hexadecimal: Column | None = None) -> Column:
    """Every letter and digit by another of its class, all else as it is."""
    pick = lambda alphabet, i: F.substring(F.lit(alphabet), _draw(digest, i, len(alphabet)) + 1, F.lit(1))
    hex_letters = F.lit(False) if hexadecimal is None else hexadecimal

    def one(c: Column, i: Column) -> Column:
        return (F.when(c.rlike("[0-9]"), pick("0123456789", i))
                .when(c.rlike("[a-z]"), F.when(hex_letters, pick("abcdef", i)).otherwise(pick("abcdefghijklmnopqrstuvwxyz", i)))
                .when(c.rlike("[A-Z]"), F.when(hex_letters, pick("ABCDEF", i)).otherwise(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)))
                .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя", i))
                .when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω", i))
                .when(c.rlike(r"\p{L}"), pick(_LETTERS, i)).when(c.rlike(r"\p{N}"), pick("0123456789", i))
                .otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum with the last digit undoubled."""
    reverse = F.split(F.reverse(digits), "")
    doubled = F.transform(reverse, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9)
                                                       .otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _with_check_digit(digits: Column) -> Column:
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.concat(body, ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))


def _iban_check(iban: Column) -> Column:
    """The IBAN with the check digits that its country and account call for."""
    letters = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 2), F.lit("00")), "")
    rest = F.aggregate(letters, F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.concat(F.substring(iban, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"),
                    F.substring(iban, F.lit(5), F.length(iban)))


def _name(kind: Column, digest: Column, attempt: Column) -> Column:
    """A name of the kind's script and gender; later attempts grow longer."""
    out = F.lit(None).cast("string")
    for (role, script), endings in ENDINGS.items():
        table = _literals(SYLLABLES[script])
        count = F.when(F.length("canon") > 5, 3).otherwise(2) + F.floor(attempt / 4).cast("int")
        stem = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.element_at(
            table, _draw(digest, i, len(SYLLABLES[script])) + 1)), "")
        end = F.element_at(_literals(endings), _draw(digest, F.lit(9), len(endings)) + 1)
        out = F.when(kind == f"{role}:{script}", F.concat(stem, end)).otherwise(out)
    return out


def _drawn(entities: DataFrame, key: str, *columns: str) -> DataFrame:
    """``entities`` (kind, canon, attempt) with a candidate ``surrogate``."""
    domain = F.substring("canon", F.instr("canon", "@") + 1, F.length("canon"))
    seeded = entities.withColumns({"_seed": _seed(key, F.col("kind"), F.col("canon"), F.col("attempt").cast("string")),
                                   "_host": _seed(key, F.lit("domain"), domain)})
    return seeded.select(*columns, _candidate().alias("surrogate"))


def _candidate() -> Column:
    """The surrogate of (kind, canon) at an attempt."""
    kind, canon, attempt, digest = F.col("kind"), F.col("canon"), F.col("attempt"), F.col("_seed")
    digits = _same_class(canon, digest)
    at = F.instr(canon, "@")
    domain = F.substring(canon, at + 1, F.length(canon))
    stem = F.regexp_replace(domain, r"\.[^.]*$", "")
    host = F.concat(_same_class(stem, F.col("_host")),
                    F.regexp_extract(domain, r"\.[^.]*$", 0))
    # A short local part has few values under a host: later attempts grow longer.
    longer = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 4).cast("int")), lambda i: F.when(
        i > 0, F.substring(F.lit(_LETTERS), _draw(digest, F.length(canon) + i, 26) + 1, F.lit(1))).otherwise("")), "")
    email = F.concat(_same_class(F.substring(canon, F.lit(1), at - 1), digest), longer, F.lit("@"), host)
    octets = F.array_join(F.transform(F.split(canon, r"\."), lambda o, i: (
        F.when(i == 0, 1 + _draw(digest, i, 223)).otherwise(_draw(digest, i, 254) + 1)).cast("string")), ".")
    iban = _iban_check(F.concat(F.substring(canon, 1, 2), _same_class(F.substring(canon, F.lit(3), F.length(canon)), digest)))
    return (F.when(kind == "email", email).when(kind == "ipv4", octets).when(kind == "iban", iban)
            .when(kind == "card", F.when(_luhn_sum(canon) % 10 == 0, _with_check_digit(digits)).otherwise(digits))
            .when(kind.isin("phone", "ssn"), digits)
            .when(kind == "secret", _same_class(canon, digest, canon.rlike("^[0-9a-f]*$|^[0-9A-F]*$")))
            .otherwise(_name(kind, digest, attempt)))


def surrogates(entities: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """kind, canon, surrogate for every distinct (kind, canon): distinct inside
    a kind, and never an entity of that kind itself. An error says that a digit
    format has fewer free values than entities."""
    known = stored(entities.select("kind", "canon").distinct(), "surrogates-entities")
    given = known.select("kind", F.col("canon").alias("surrogate"))     # values that are taken
    now, done, left = known.withColumn("attempt", F.lit(0)), None, None
    order = Window.partitionBy("kind", "surrogate").orderBy("canon")
    for attempt in range(MOST_ROUNDS):
        # Only what collided is drawn again: with an entity, a surrogate given before, or another draw.
        drawn = _drawn(now, key, "kind", "canon").withColumn("_place", F.row_number().over(order))
        taken = given
        if left is not None:               # few by now: only the values that they ask for
            taken = given.join(drawn.select("kind", "surrogate"), ["kind", "surrogate"], "left_semi").distinct()
        taken = taken.select(F.col("kind").alias("k"), F.col("surrogate").alias("s"), F.lit(True).alias("real"))
        judged = (drawn.join(taken, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s")), "left")
                  .select("kind", "canon", "surrogate", (F.col("real").isNotNull() | (F.col("_place") > 1)).alias("again")))
        if left is not None:               # a file for so many entities, not one for each shuffle partition
            judged = judged.coalesce(1 + left // ENTITIES_PER_FILE)
        judged = stored(judged, "surrogates-drawn")
        fresh = judged.where("not again").select("kind", "canon", "surrogate")
        done = fresh if done is None else done.union(fresh)
        now = judged.where("again").select("kind", "canon", F.lit(attempt + 1).alias("attempt"))
        left = now.count()
        if not left:
            return done
        given = given.union(fresh.select("kind", "surrogate"))
    return _filled(done.withColumn("again", F.lit(False)).union(
        now.select("kind", "canon", F.lit(None).cast("string"), F.lit(True))), known, key)


def _filled(drawn: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``drawn`` with a free value of its format for every entity to draw
    ``again``. Draws fail this often only if the entities of a format are about
    as many as its values, so listing the values is no more work than those."""
    luhn = (F.col("kind") == "card") & (_luhn_sum(F.col("canon")) % 10 == 0)
    done = drawn.where("not again").select("kind", "canon", "surrogate")
    left = drawn.where("again").select("kind", "canon", F.length("canon").alias("n"), luhn.alias("luhn"))
    for kind, n, checked in left.select("kind", "n", "luhn").distinct().collect():    # formats, not entities
        i = F.col("id").cast("string")
        if kind in _DIGIT_KINDS:
            room = 10 ** (n - checked)
            value = _with_check_digit(F.concat(F.lpad(i, n - 1, "0"), F.lit("0"))) if checked else F.lpad(i, n, "0")
        else:
            raise RuntimeError(f"the {kind} entities of {n} characters have too few values for distinct surrogates")
        used = known.where(F.col("kind") == kind).select(F.col("canon").alias("v")).union(
            done.where(F.col("kind") == kind).select(F.col("surrogate").alias("v")))
        free = drawn.sparkSession.range(room).select(value.alias("v")).join(used, "v", "left_anti")
        mine = left.where((F.col("kind") == kind) & (F.col("n") == n) & (F.col("luhn") == checked)).select(F.col("canon").alias("v"))
        (mine, wanted), (free, there) = _ranked(mine, key), _ranked(free, key)
        if wanted > there:
            raise RuntimeError(f"{wanted} {kind} entities of {n} characters, but {there} free values for distinct surrogates")
        pairs = mine.withColumnRenamed("v", "canon").join(free.withColumnRenamed("v", "surrogate"), "rank")
        done = stored(done.union(pairs.select(F.lit(kind).alias("kind"), "canon", "surrogate")), "surrogates-filled")
    return done


def _ranked(values: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``v, rank`` in a keyed order, ranked bucket by bucket, and the number of rows."""
    values = stored(values.select("v", F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("rank"), "v").cast("binary"), 256).alias("h"))
                    .withColumn("b", F.substring("h", 1, 2)), "surrogates-ranked")
    counts = dict(values.groupBy("b").count().collect())            # 256 buckets at most
    below, start = 0, []
    for b in sorted(counts):
        start += [(b, below)]
        below += counts[b]
    if not start:
        return values.select("v", F.lit(0).cast("long").alias("rank")), 0
    starts = F.create_map(*[F.lit(x) for pair in start for x in pair])
    order = F.row_number().over(Window.partitionBy("b").orderBy("h", "v"))
    return values.select("v", (F.element_at(starts, F.col("b")) + order.cast("long")).alias("rank")), below


def _titled(piece: Column, surrogate: Column) -> Column:
    return F.when((F.upper(piece) == piece) & (F.length(piece) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))


def _names(found: Column) -> Column:
    """Maps name -> surrogate from structs (canon, kind, surrogate), dealt by a
    hash of the name: a lookup in a map of Spark reads it through, so about the
    square root of the names is in each. A name that is a surname and a given
    name is the surname."""
    by_name = F.sort_array(found, asc=False)
    first = F.filter(by_name, lambda x, i: ~F.get(by_name, i - 1)["canon"].eqNullSafe(x["canon"]))
    return F.transform(first, lambda x: F.struct(x["canon"].alias("name"), x["surrogate"].alias("new")))


def _dealt(names: Column) -> Column:
    parts = F.ceil(F.sqrt(F.size(names))).cast("int")
    one = lambda b: F.map_from_entries(F.filter(names, lambda x: F.pmod(F.hash(x["name"]), parts) == b))
    return F.when(F.size(names) > 0, F.transform(F.sequence(F.lit(0), parts - 1), one)).otherwise(
        F.array().cast("array<map<string,string>>"))


def _untitled(text: Column, names: Column) -> Column:
    """A text with every name of ``names`` (dealt maps) replaced, and how many
    there were: a struct (text, n)."""
    pattern = rf"(?<!\p{{L}}){_NAME_TOKEN}"
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    one = lambda w: F.element_at(F.get(names, F.pmod(F.hash(F.lower(w)), F.size(names))), F.lower(w))
    new = lambda w: F.coalesce(_titled(w, one(w)), F.array_join(F.transform(
        F.split(w, "-"), lambda p: F.coalesce(_titled(p, one(p)), p)), "-"))
    some = lambda w: one(w).isNotNull() | F.exists(F.split(w, "-"), lambda p: one(p).isNotNull())
    out = F.array_join(F.zip_with(F.split(text, pattern, -1), F.transform(words, new),
                                  lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    any_ = F.size(names) > 0
    return F.struct(F.when(any_, out).otherwise(text).alias("text"),
                    F.when(any_, F.size(F.filter(words, some))).otherwise(0).alias("n"))


def _written(piece: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the format of the piece it stands for."""
    gaps = F.split(piece, "[0-9]")
    filled = F.array_join(F.zip_with(gaps, F.split(surrogate, ""), lambda g, d: F.concat(F.coalesce(g, F.lit("")), F.coalesce(d, F.lit("")))), "")
    case = lambda old, new: F.array_join(F.zip_with(F.split(old, ""), F.split(new, ""), lambda p, s: F.when(
        p.rlike(r"\p{Lu}"), F.upper(s)).otherwise(s)), "")
    cased = F.concat_ws("@", *[case(F.substring_index(piece, "@", n), F.substring_index(surrogate, "@", n)) for n in (1, -1)])
    spaced = F.when(F.instr(piece, " ") > 0, F.rtrim(F.regexp_replace(surrogate, "(.{4})", "$1 "))).otherwise(surrogate)
    title = _titled(piece, surrogate)
    return (F.when(kind == "literal", piece).when(kind.isin(*_DIGIT_KINDS), filled)
            .when(kind == "email", cased).when(kind == "iban", spaced)
            .when(kind.isin("ipv4", "secret"), surrogate).otherwise(title))


def replace_pii(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY, counts: str | None = None) -> DataFrame:
    """``docs`` with the mentions in ``text`` replaced; ``counts`` names an
    added column with the number of mentions."""
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    t = F.col(names[text])
    work = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    # The one-row generator keeps the filters below from repeating the search.
    found = work.select("*", F.inline(F.array(F.struct(
        F.coalesce(find_mentions(t), F.array().cast("array<string>")).alias("_found")))))
    # A list of mentions is known by its digest: no row but the text's own and one for each
    # distinct list holds it.
    listed = F.sha2(F.array_join("_found", "\x1f").cast("binary"), 256)
    hits = stored(found.where(F.size("_found") > 0).withColumn("_list", listed), "surrogates-hits")
    mentions = (hits.groupBy("_list").agg(F.first("_found").alias("_found"))
                .select("_list", F.posexplode("_found").alias("_at", "_mention"))
                .select("_list", "_at", F.posexplode(_parts(F.col("_mention"))).alias("_part", "p"))
                .select("_list", "_at", "_part", "p.*"))
    mentions = stored(mentions, "surrogates-mentions")
    table = surrogates(mentions.where("kind <> 'literal'"), key)
    table = table.select(F.col("kind").alias("k"), F.col("canon").alias("c"), "surrogate")
    written = (mentions.join(table, (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c")), "left")
               .select("_list", "_at", "_part", _written(F.col("piece"), F.col("kind"), F.col("surrogate")).alias("w"),
                       F.when(F.col("kind").rlike("^(given|surname)"), F.struct("canon", "kind", "surrogate")).alias("name")))
    whole = written.groupBy("_list", "_at").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_part", "w"))), lambda x: x["w"]), "").alias("w"),
        F.collect_list("name").alias("names"))
    replaced = whole.groupBy("_list").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "w"))), lambda x: x["w"]).alias("_new"),
        F.array_distinct(F.flatten(F.collect_list("names"))).alias("_names"))
    replaced = replaced.select(F.col("_list").alias("_l"), "_new", _names(F.col("_names")).alias("_names"))
    once = lambda c, name: F.inline(F.array(F.struct(c.alias(name))))    # evaluated once, whatever reads it
    changed = (hits.join(replaced, F.col("_list") == F.col("_l"))
               .select("*", once(_dealt(F.col("_names")), "_maps"))
               .select("*", once(F.transform(F.split(t, ANY, -1), lambda a: _untitled(a, F.col("_maps"))), "_pieces")))
    text_out = F.array_join(F.zip_with("_pieces", "_new", lambda a, b: F.concat(a["text"], F.coalesce(b, F.lit("")))), "")
    again = F.aggregate("_pieces", F.lit(0), lambda n, a: n + a["n"])
    changed = changed.select("*", text_out.alias("_text"), (F.size("_found") + again).alias("_count"))

    def out(new: Column, count: Column) -> list[Column]:
        columns = [(new if c == text else F.col(n)).alias(c) for c, n in names.items() if c != counts]
        return columns + ([count.cast("bigint").alias(counts)] if counts else [])

    same = found.where(F.size("_found") == 0).select(*out(t, F.lit(0)))
    return same.unionAll(changed.select(*out(F.col("_text"), F.col("_count"))))


def op8_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(docs, counts="n_mentions").select("doc_id", "n_mentions", "text")
