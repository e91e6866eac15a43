"""PII: detected entities get keyed surrogates of the same type, gender, script and format. DataFrame functions only.

Found are e-mail addresses, telephone numbers, IPv4 addresses, payment cards (by their check digit), social security
numbers, access keys, secrets after token= and the like, and persons' names. A name begins after a title (Mrs. Miller),
after a phrase that names a person (my name is ..., Dear ...) or with a common given name; every word of a name so found is
then replaced wherever it stands alone in that document. A person whom nothing of this introduces isn't found.

The key, an entity's canonical form (digits, lower case) and how often it had to draw decide its surrogate, so the same
entity gets the same surrogate in all documents of a run, however it is written; whether it draws again depends on the
corpus (below). Numbers are permuted by a four-round Feistel network, which sends different numbers to different numbers:
cards keep their first digit and a right check digit, North American telephone numbers their exchange (for the first draws),
addresses their kind (private, loopback and other reserved networks stay such, public ones public). Other entities change
letter for letter and digit for digit, of any length; what is hexadecimal stays so; an e-mail address keeps its last labels,
and one domain always becomes the same other one. The words of names are made of syllables of their script and end as names of
their gender do (a listed given name's, or else that which the word's own end shows), in the case that they are written in.

Collision check: the distinct entities of the corpus (summed map-side) are tabled with their surrogates. An entity whose
surrogate is also that of another, or is itself an entity of the corpus, draws again, until none is left; each draw after
the second has more syllables to choose from. Those that drew again are given to the documents that hold them. So
surrogates are distinct, and none is an original of its type. If a type's numbers are used up, so that no draw of fifty
helps any more, it is an error.

Defined results: a null text stays null with no entities; an empty one stays empty; a very long text or entity is changed
whole; repeated rows change alike; of entities that draw the same surrogate the least keeps it; marks that the operator
uses inside a text are escaped and come back; empty tables give no rows; other columns pass through unless they have the
name of an output column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import aside, forget, join_few, keep, table

#: The session setting that holds the key, and what the registered query takes where it is unset: for tests only.
KEY_SETTING, DEMONSTRATION_KEY = "spark.docloom.pii.key", "for demonstration only"

#: Titles, phrases that a name follows, words that follow such phrases without being names.
TITLES = "Mr Mrs Ms Miss Mx Sir Madam Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Señorita господин госпожа".split()
CUES = ["my name is", "My name is", "Name:", "name:", "Dear", "Signed,", "signed,", "Regards,", "regards,", "Sincerely,", "sincerely,", "ich heiße", "Ich heiße", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "Cher", "Chère", "me llamo", "Me llamo", "Estimado", "Estimada", "меня зовут", "Меня зовут"]
NO_NAMES = "All Friend Friends Customer Customers Colleague Colleagues Team Reader Readers Editor Everyone Lord God".split()
#: Common given names by gender; particles inside names; ends of feminine names.
GIVEN = {
    "m": "James Robert Michael David Thomas Charles Peter Klaus Jürgen Pierre Jacques Carlos José Miguel Luis Frank Иван Дмитрий Сергей Алексей Николай Павел Михаил Андрей".split(),
    "f": "Mary Patricia Linda Susan Sarah Karen Julia Emma Claudia Monique Sylvie Carmen Lucía Beatriz Ursula Brigitte Мария Ольга Наталья Светлана Елена Татьяна Ирина Людмила".split(),
}
PARTICLES = "van von der den de la di da del du dos".split()
FEMININE_END = "[aаяαη]$"
#: By script syllables, and ends of masculine and feminine names.
SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga go ka ke ko la lo ma mo na no pa po ra ro sa so ta to va vo wa wo za".split(), "d k l n r s".split(), "da ka la na ra sa".split()),
    "cyrillic": ("ба бо ва ве да де за зо ка ко ла ло ма ме мо на не но па по ра ре ро са со та те то фа хо ша ши".split(), "д к л н р с".split(), "да ка ла на ра са".split()),
    "greek": ("βα βε βο γα γο δα δε δο ζα ζο κα κε κο λα λε λο μα με μο να νε νο πα πο ρα ρο σα σο τα τε το φα".split(), "ς ν ρ ξ".split(), "δα κα λα να ρα".split()),
}

_ANY_TITLE, _ANY_CUE, _ANY_GIVEN = "|".join(TITLES), "|".join(CUES), "|".join(GIVEN["m"] + GIVEN["f"])
_STAY = "|".join([*TITLES, *dict.fromkeys(w.strip(",:'") for c in CUES for w in c.split())])
_FIRST = "".join(sorted({x[0] for x in (*TITLES, *CUES, *GIVEN["m"], *GIVEN["f"])}))  # looked at first: few places pass
_WORD = r"\p{Lu}\p{L}+(?:['’-]\p{Lu}\p{L}+)*"
_GAP = rf"(?: (?:{'|'.join(PARTICLES)}))* "
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET_NAME = r"(?:token|password|passwd|passphrase|pwd|secret|api_key|apikey|api-key|Token|Password|Passwd|Secret|TOKEN|PASSWORD|PASSWD|SECRET|API_KEY|APIKEY)"
_BARE = r"[^\s\"'<>,;&]{7,}[A-Za-z0-9_+/=!@#$%^*~-]"
#: What each type looks like; the first that fits a found string names its type.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\d+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){3,6}(?!\d)",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4})(?![\d-])",
    "access": r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])",
    "secret": rf"(?<![\p{{L}}\p{{N}}]){_SECRET_NAME}[\"']? ?(?:[=:] ?\"[^\"\s]{{6,}}\"|[=:] ?'[^'\s]{{6,}}'|= ?\"?{_BARE}|: ?(?=\S*\d){_BARE})",
    "name": rf"(?=[{_FIRST}])(?<!\p{{L}})(?:(?:{_ANY_TITLE})\.? {_WORD}(?:{_GAP}{_WORD}){{0,2}}|(?:{_ANY_CUE})[ \n](?!(?:{_ANY_TITLE}|{'|'.join(NO_NAMES)})(?!\p{{L}})){_WORD}(?:{_GAP}{_WORD}){{0,2}}|(?:{_ANY_GIVEN})(?!\p{{L}})(?:{_GAP}{_WORD}){{0,2}})",
}
_ALL = "(" + "|".join(PATTERNS.values()) + ")"
#: Only texts with one of these can hold anything but names; an access key may be of letters alone.
_HINT, _ACCESS = "[0-9@=:]", "AKIA"
_SECRET = r"^(.*?[=:] ?[\"']?)(.*?)([\"']?)$"
MARK, ESC = "\ue000", "\ue002"
#: First numbers of addresses that aren't simply public; with these three the second number stays too.
RESERVED, HALF_RESERVED = [10, 127, 169, 172, 192], [169, 172, 192]
#: Draws without success after which a type counts as used up.
IDLE_ROUNDS = 50


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(key: str, tag: str | Column, message: Column, below: Column | int) -> Column:
    """A keyed number from 0 to below - 1."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    digest = F.sha2(F.concat(F.lit(key + "|"), tag, F.lit("|"), message, F.lit("|" + key)), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), (F.lit(below) if isinstance(below, int) else below).cast("bigint"))


def _feistel(key: str, tag: Column, left: Column, right: Column, a: int | Column, b: int | Column) -> tuple[Column, Column]:
    """A keyed permutation of the pairs (left below a, right below b)."""
    wide = lambda n: (F.lit(n) if isinstance(n, int) else n).cast("bigint")
    l, r = left.cast("bigint"), right.cast("bigint")
    for k in (1, 3):
        l = F.pmod(l + _number(key, F.concat(tag, F.lit(str(k))), r.cast("string"), a), wide(a))
        r = F.pmod(r + _number(key, F.concat(tag, F.lit(str(k + 1))), l.cast("string"), b), wide(b))
    return l, r


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def scrambled(text: Column, seed: Column) -> Column:
    """text with each letter and digit replaced by a keyed one of its kind; hexadecimal text stays so. Any length."""
    any_of = lambda alphabet, x: F.substr(F.lit(alphabet), x % len(alphabet) + 1, F.lit(1))

    def one(c: Column, x: Column) -> Column:
        return (
            F.when(c.between("0", "9"), any_of("0123456789", x))
            .when(c.between("a", "z"), any_of("abcdefghijklmnopqrstuvwxyz", x))
            .when(c.between("A", "Z"), any_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", x))
            .when(c.between("а", "я"), any_of("абвгдежзиклмнопрстуфхцчшщэюя", x))
            .when(c.between("А", "Я"), any_of("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", x))
            .when(c.rlike(r"\p{Lu}"), any_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", x))
            .when(c.rlike(r"\p{L}"), any_of("abcdefghijklmnopqrstuvwxyz", x))
            .otherwise(c)
        )

    def numbers(s: Column) -> Column:
        """A byte for each character of text, from as many digests as it takes."""
        digests = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 32).cast("int")), lambda k: F.regexp_extract_all(F.sha2(F.concat(s, F.lit("|"), k.cast("string")), 256), F.lit("(..)"), 1))
        return F.slice(F.transform(F.flatten(digests), lambda h: F.conv(h, 16, 10).cast("int")), 1, F.length(text))

    def walked(s: Column) -> Column:
        chars = F.split(text, "")
        low, high = text.rlike("^(?=.*[a-f])[0-9a-f-]+$"), text.rlike("^(?=.*[A-F])[0-9A-F-]+$")
        pick = lambda f: F.array_join(F.zip_with(chars, numbers(s), f), "")
        return F.when(low, pick(lambda c, x: F.when(c == "-", c).otherwise(any_of("0123456789abcdef", x)))).when(high, pick(lambda c, x: F.when(c == "-", c).otherwise(any_of("0123456789ABCDEF", x)))).otherwise(pick(one))

    return F.when(F.length(text) == 0, "").otherwise(_let(seed, walked))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substr(digits, i, F.lit(1)).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def kind_of(found: Column) -> Column:
    """Type of a found string, or 'none' (a long number that is no card, a number too short or long to be dialled)."""
    out = F.lit("none")
    for kind, pattern in reversed(list(PATTERNS.items())):
        fits = found.rlike(f"^(?:{pattern})$")
        if kind == "card":
            fits = fits & (F.pmod(luhn_sum(F.regexp_replace(found, r"[ -]", "")), F.lit(10)) == 0)
        if kind == "phone":
            fits = fits & F.length(F.regexp_replace(found, r"\D", "")).between(8, 15)
        out = F.when(fits, F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, r"\D", "")
    phone = F.when(found.rlike(f"^\\+(?!1\\D|1\\d{{10}}$).*$") & ~found.rlike(r"\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}$"), F.concat(F.lit("+"), digits)).otherwise(F.substring(digits, -10, 10))
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "email", F.lower(found)).when(kind == "secret", F.regexp_extract(found, _SECRET, 2)).when(kind == "name", F.lower(found)).otherwise(found)


def _address(canon: Column, key: str, tag: Column) -> Column:
    """An IPv4 address of the same kind: a public network moves among public ones, what is reserved keeps its first numbers."""
    octets = F.split(canon, r"\.")
    octet = lambda k: F.element_at(octets, k).cast("bigint")
    first = octet(1)
    half = first.isin(HALF_RESERVED)
    public = first.between(1, 223) & ~first.isin(RESERVED)
    n = 223 - len(RESERVED)
    place = first - 1 - sum(((first > x).cast("int") for x in RESERVED[1:]), (first > RESERVED[0]).cast("int"))
    low = F.when(half, octet(3) * 256 + octet(4)).otherwise(octet(2) * 65536 + octet(3) * 256 + octet(4))
    stays = F.when(public, "").when(half, F.concat_ws(".", octet(1).cast("string"), octet(2).cast("string"))).otherwise(octet(1).cast("string"))
    l, r = _feistel(key, F.concat(tag, stays), F.when(public, place).otherwise(0), low, F.when(public, n).otherwise(1), F.when(half, 1 << 16).otherwise(1 << 24))

    def written(x: Column) -> Column:
        back = x["l"] + 1
        for gone in RESERVED:
            back = back + (back >= gone).cast("int")
        lead = F.when(public, back).otherwise(first).cast("string")
        second = F.when(half, octet(2)).otherwise(F.floor(x["r"] / 65536)).cast("string")
        return F.concat_ws(".", lead, second, F.floor(x["r"] % 65536 / 256).cast("string"), (x["r"] % 256).cast("string"))

    return _let(F.struct(l.alias("l"), r.alias("r")), written)


def _name(canon: Column, attempt: Column, key: str, tag: Column) -> Column:
    """A word of a name: syllables of its script, more of them with the draws, and an end of its gender."""
    male, female = (F.array(*[F.lit(x.lower()) for x in GIVEN[g]]) for g in "mf")
    feminine = F.array_contains(female, canon) | (~F.array_contains(male, canon) & canon.rlike(FEMININE_END))

    def made(script: str) -> Column:
        syllables, m_ends, f_ends = SYLLABLES[script]
        pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (_number(key, F.concat(tag, k), canon, len(values)) + 1).cast("int"))
        body = F.array_join(F.transform(F.sequence(F.lit(1), 4 + F.floor(attempt / 2).cast("int")), lambda k: pick(syllables, F.concat(F.lit("s"), k.cast("string")))), "")
        return F.concat(body, F.when(feminine, pick(f_ends, F.lit("f"))).otherwise(pick(m_ends, F.lit("m"))))

    return F.when(canon.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a canonical entity; another for each attempt."""
    tag = F.concat(kind, F.lit("#"), attempt.cast("string"), F.lit("#"))
    seed = F.sha2(F.concat(F.lit(key + "|"), tag, canon, F.lit("|" + key)), 256)

    area, exchange, line = F.substring(canon, 1, 3), F.substring(canon, 4, 3), F.substring(canon, 7, 4)
    l, r = _feistel(key, F.concat(tag, exchange), area, line, 1000, 10_000)
    near = F.concat(_padded(l, 3), exchange, _padded(r, 4))
    l, r = _feistel(key, tag, F.substring(canon, 1, 6), line, 1_000_000, 10_000)
    far = F.concat(_padded(l, 6), _padded(r, 4))
    abroad = F.concat(F.substring(canon, 1, 3), scrambled(F.substr(canon, F.lit(4)), seed))
    phone = F.when(canon.startswith("+"), abroad).when(attempt < 8, near).otherwise(far)

    l, r = _feistel(key, tag, F.substring(canon, 1, 4), F.substring(canon, 5, 5), 10_000, 100_000)
    ssn = F.concat(_padded(l, 4), _padded(r, 5))

    # first digit, six digits, then the rest but the check digit, which is made right again
    n = F.length(canon)
    rest = n - 8
    width = F.pow(F.lit(10.0), rest.cast("double")).cast("bigint")
    l, r = _feistel(key, F.concat(tag, F.substring(canon, 1, 1)), F.substring(canon, 2, 6), F.substr(canon, F.lit(8), rest), 1_000_000, width)
    body = F.concat(F.substring(canon, 1, 1), _padded(l, 6), F.lpad(r.cast("string"), rest, F.lit("0")))
    card = _let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))

    # one domain always becomes the same other one; its last label stays, and with a country's also "co" and the like
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.regexp_extract(domain, r"((?:\.(?:co|com|org|net|ac|gov|edu))?\.[a-z]{2}|\.[^.]+)$", 1)
    site = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(scrambled(local, seed), F.lit("@"), scrambled(site, F.sha2(F.concat(F.lit(key + "|domain|"), domain, F.lit("|" + key)), 256)), top)

    base32 = F.translate(F.substring(seed, 1, 16), "0123456789abcdef", "ABCDEFGH2345KLMN")
    access = F.concat(F.lit("AKIA"), base32)
    made = {"phone": phone, "ip": _address(canon, key, tag), "ssn": ssn, "card": card, "email": email, "access": access, "secret": scrambled(canon, seed), "name": _name(canon, attempt, key, tag)}
    return reduce(lambda out, x: F.when(kind == x[0], x[1]).otherwise(out), reversed(list(made.items())), canon)


def _cased(like: Column, text: Column) -> Column:
    """text in capitals, with a capital first letter or in lower case, as `like` is."""
    return F.when((like == F.upper(like)) & (like != F.lower(like)), F.upper(text)).when(F.substring(like, 1, 1) != F.lower(F.substring(like, 1, 1)), F.initcap(text)).otherwise(text)


def _filled(found: Column, digits: Column) -> Column:
    """found with its last digits replaced by `digits`; what stands between them stays."""
    more = F.length(F.regexp_replace(found, r"\D", "")) - F.length(digits)
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.when(s["k"] > 0, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(F.split(found, ""), F.struct(F.lit("").alias("out"), (1 - more).alias("k")), step, lambda s: s["out"])


def render(kind: Column, found: Column, made: Column) -> Column:
    """A canonical surrogate written as `found` is written."""
    digits = F.when(made.startswith("+"), F.substr(made, F.lit(2))).otherwise(made)
    email = F.when((found == F.upper(found)) & (found != F.lower(found)), F.upper(made)).otherwise(made)
    return F.when(kind.isin("phone", "ssn", "card"), _filled(found, digits)).when(kind == "email", email).when(kind == "secret", F.concat(F.regexp_extract(found, _SECRET, 1), made, F.regexp_extract(found, _SECRET, 3))).otherwise(made)


def _runs(name: Column) -> Column:
    """A found name as runs of letters and of what stands between them."""
    return F.regexp_extract_all(name, F.lit(r"(\p{L}+|\P{L}+)"), 1)


def _is_name_word(run: Column) -> Column:
    return run.rlike(rf"^(?!(?:{_STAY})$)\p{{Lu}}\p{{L}}+$")


def entities(docs: DataFrame) -> DataFrame:
    """Adds __found: the text in order as (found, kind); kind is null outside entities, and where there are none all is null."""
    safe = F.replace(F.replace(F.col("text"), F.lit(ESC), F.lit(ESC + "b")), F.lit(MARK), F.lit(ESC + "a"))
    marked = F.when(F.col("text").rlike(_HINT) | F.col("text").contains(_ACCESS), F.regexp_replace(safe, _ALL, f"{MARK}$1{MARK}")).otherwise(F.regexp_replace(safe, f"({PATTERNS['name']})", f"{MARK}$1{MARK}"))
    df = docs.withColumn("__pieces", F.split(marked, MARK))
    none = F.lit(None).cast("string")
    typed = F.transform("__pieces", lambda p, i: F.struct(p.alias("found"), F.when(i % 2 == 1, F.nullif(kind_of(p), F.lit("none"))).alias("kind")))
    df = df.withColumn("__typed", F.when(F.size("__pieces") > 1, typed))
    # words of the names found so, wherever they stand alone
    words = F.array_distinct(F.flatten(F.transform(F.filter("__typed", lambda x: x["kind"] == "name"), lambda x: F.filter(_runs(x["found"]), _is_name_word))))
    df = df.withColumn("__words", F.when(F.exists("__typed", lambda x: x["kind"] == "name"), words))
    alone = F.concat(F.lit(r"(?<![\p{L}\p{N}])("), F.array_join(F.array_distinct(F.concat("__words", F.transform("__words", lambda w: F.upper(w)))), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    df = df.withColumn("__alone", F.when(F.size("__words") > 0, alone))

    def parted(x: Column) -> Column:
        pieces = F.split(F.regexp_replace(x["found"], F.col("__alone"), F.lit(f"{MARK}$1{MARK}")), MARK)
        return F.when(x["kind"].isNull(), F.transform(pieces, lambda p, i: F.struct(p.alias("found"), F.when(i % 2 == 1, "name").otherwise(none).alias("kind")))).otherwise(F.array(x))

    return df.withColumn("__found", F.when(F.col("__alone").isNotNull(), F.flatten(F.transform("__typed", parted))).otherwise(F.col("__typed"))).drop("__pieces", "__typed", "__words", "__alone")


def _keyed(docs: DataFrame) -> DataFrame:
    """kind, canon of everything that needs a surrogate, with the document's __a and __b."""
    one = lambda kind, found: F.struct(kind.alias("kind"), canonical(kind, found).alias("canon"))
    words = lambda x: F.transform(F.filter(_runs(x["found"]), _is_name_word), lambda r: one(F.lit("name"), r))
    each = F.transform(F.filter("__found", lambda x: x["kind"].isNotNull()), lambda x: F.when(x["kind"] == "name", words(x)).otherwise(F.array(one(x["kind"], x["found"]))))
    listed = entities(docs).select("__a", "__b", F.array_distinct(F.flatten(each)).alias("__each"))
    return listed.select("__a", "__b", F.explode_outer("__each").alias("x")).where("x.kind IS NOT NULL").select("__a", "__b", "x.*").distinct()  # outer: else the optimiser repeats the whole expression in a filter of its own


def redraws(keyed: DataFrame, key: str) -> DataFrame | None:
    """kind, canon, attempt of the entities whose first surrogate collides; None if there are none."""
    spark = keyed.sparkSession
    made = lambda attempt: surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key).alias("made")
    # dealt to all cores, however small the table: a surrogate costs much more than its bytes say
    distinct = keyed.select("kind", "canon").distinct().repartition(2 * spark.sparkContext.defaultParallelism, "kind", "canon")
    first = keep(distinct.select("kind", "canon", made(0)), "entities")
    taken = first.select("kind", "made").unionByName(first.select("kind", F.col("canon").alias("made")))  # all first draws, all originals

    def losers(drawn: DataFrame) -> DataFrame:
        """Of those that drew the same surrogate all but the least."""
        several = drawn.groupBy("kind", "made").agg(F.min("canon").alias("__least"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
        return join_few(drawn, keep(several, "several"), ["kind", "made"], "inner", "octet_length(made) + octet_length(__least)").where("canon <> __least").select("kind", "canon")

    originals = first.select("kind", F.col("canon").alias("made"))
    pending = keep(losers(first).unionByName(first.join(originals, ["kind", "made"], "left_semi").select("kind", "canon")).distinct(), "pending")
    waiting, attempt, idle, accepted = pending.count(), 0, 0, []
    while waiting:
        attempt += 1
        drawn = keep(pending.select("kind", "canon", made(attempt)), "drawn")
        gone = losers(drawn)
        for used in (taken, *accepted):
            hit = join_few(used.select("kind", "made"), drawn.select("kind", "made").distinct(), ["kind", "made"], "inner", "octet_length(made)")
            gone = gone.unionByName(join_few(drawn, keep(hit.distinct(), "hit"), ["kind", "made"], "inner", "octet_length(made)").select("kind", "canon"))
        forget(pending)
        pending = keep(gone.distinct(), "pending")
        accepted.append(keep(join_few(drawn, pending, ["kind", "canon"], "left_anti", "octet_length(canon)").withColumn("attempt", F.lit(attempt)), "accepted"))
        forget(drawn)
        left = pending.count()
        idle = idle + 1 if left == waiting else 0
        waiting = left
        if idle == IDLE_ROUNDS:
            kinds = sorted(r[0] for r in pending.select("kind").distinct().collect())  # of eight kinds
            raise RuntimeError(f"no surrogates are left of: {', '.join(kinds)}")
    return reduce(DataFrame.unionByName, accepted).select("kind", "canon", "attempt") if accepted else None


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced, n_entities and entity_types."""
    if not key:
        raise ValueError("surrogates need a key")
    rest = [c for c in docs.columns if c not in ("n_entities", "entity_types")]
    own = docs.select(*rest).withColumns({"__a": F.xxhash64("text"), "__b": F.xxhash64(F.lit(1), "text")})
    keyed = keep(_keyed(own.select("text", "__a", "__b")), "keyed")  # texts are searched once for it
    again = redraws(keyed, key)
    if again is None:
        own = own.withColumn("__again", F.lit(None).cast("map<string, int>"))
    else:
        per_text = join_few(keyed, keep(again, "again"), ["kind", "canon"], "inner", "octet_length(canon)").groupBy("__a", "__b").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.concat("kind", F.lit(":"), "canon"), "attempt")))).alias("__again"))
        own = join_few(own, keep(per_text, "per-text"), ["__a", "__b"], "left", "aggregate(map_keys(__again), 0L, (s, x) -> s + 16 + octet_length(x))")

    def drawn(kind: Column, canon: Column) -> Column:
        return surrogate(kind, canon, F.coalesce(F.element_at(F.col("__again"), F.concat(kind, F.lit(":"), canon)), F.lit(0)), key)

    def name(found: Column) -> Column:
        return F.array_join(F.transform(_runs(found), lambda r: F.when(_is_name_word(r), _cased(r, drawn(F.lit("name"), F.lower(r)))).otherwise(r)), "")

    # one step a column, so that no step's expression is repeated inside the next one's
    x = entities(own)
    x = x.withColumn("__y", F.transform("__found", lambda x: F.struct(x["found"].alias("found"), x["kind"].alias("kind"), canonical(x["kind"], x["found"]).alias("canon"))))
    x = x.withColumn("__z", F.transform("__y", lambda y: F.struct(y["found"].alias("found"), y["kind"].alias("kind"), F.when(y["kind"].isNull() | (y["kind"] == "name"), y["canon"]).otherwise(drawn(y["kind"], y["canon"])).alias("made"))))
    x = x.withColumn("__changed", F.transform("__z", lambda z: F.when(z["kind"].isNull(), z["found"]).when(z["kind"] == "name", name(z["found"])).otherwise(render(z["kind"], z["found"], z["made"]))))
    x = x.withColumn("__kinds", F.coalesce(F.filter(F.transform("__z", lambda z: z["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>")))
    joined = F.replace(F.replace(F.array_join("__changed", ""), F.lit(ESC + "a"), F.lit(MARK)), F.lit(ESC + "b"), F.lit(ESC))
    out = x.withColumns({"text": F.when(F.size("__kinds") > 0, joined).otherwise(F.col("text")), "n_entities": F.size("__kinds").cast("bigint"), "entity_types": F.array_sort(F.array_distinct("__kinds"))})
    return out.select(*rest, "n_entities", "entity_types")


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEMONSTRATION_KEY)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def pipeline_pii(docs: DataFrame) -> DataFrame:
    """The pipeline's fourth stage: every document with surrogates in place of its entities."""
    out = aside(docs, ["doc_id", "text"], lambda own: replace(own, session_key(docs.sparkSession)))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


#: Keyed permutations and redrawing aren't stated in SQL; the tests check format, distinctness and coreference.
ORACLES: dict[str, str] = {}
QUERIES = {"op2_pii_surrogates": op2_pii_surrogates}
