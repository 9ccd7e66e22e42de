"""PII surrogates (operator 6), DataFrame functions only.

Entities are found by one pattern: e-mail addresses, phone numbers
(international, or ten digits in the North American form),  IPv4 addresses, payment cards (Luhn-valid numbers in an issuer's range), US social
security numbers, secrets of 16 or more characters after a key word, quoted or
not, and names after a title.
Each distinct entity gets one surrogate from a keyed digest, so equal entities
get equal surrogates in every document (coreference), and of the same type:

* e-mail: letters and digits replaced in place, top-level domain kept, equal
  domains stay equal;
* phone, social security number, secret: digits and letters replaced, country
  code, punctuation and case kept; one number written in two ways gets one
  surrogate;
* card: issuer's digits, length and grouping kept, valid check digit;
* IPv4: address of the same kind (private ranges stay private);
* name: a name of the same script and gender after the same title.

Letters stay in their script (Latin, Cyrillic, Greek, Han; others become Latin). Distinct entities keep
distinct surrogates: a surrogate that two entities share, that another entity
already has, or that occurs as an entity itself is drawn again until none is
left. Where so many values of a space occur that draws fail (private IPv4
addresses), the values left are permuted among themselves by the key.
E-mails and secrets without a letter or digit to replace are left alone.

A text is put together again from the pieces between its entities, so nothing
else changes. Documents without entities are not shuffled. Only texts with
entities are joined with their replacements, by a hash of the text; the
replacement of an entity is the same everywhere, so a map with more entries
than needed does no harm.

Defined cases: null text stays null, empty text stays empty; extra columns are
passed through unchanged whatever their names; repeated rows get equal
results; an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockspark.llm.common import table

KEY = "surrogates-v1"       # production callers pass their own secret
MAX_DRAWS = 64
DENSE_DRAWS = 8             # after them a round that places less than half shows a space too dense to draw from

# ---- fixed values: titles with the gender they show, names by script and gender
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
          "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
FIRST = {("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Jonas Leon Martin Oscar Paul Simon Tomas",
         ("latin", "f"): "Anna Clara Diana Emma Greta Helena Irene Julia Laura Maria Nora Paula Sofia Vera",
         ("cyrillic", "m"): "Антон Борис Виктор Денис Егор Иван Кирилл Максим Олег Павел",
         ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Софья",
         ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Νίκος Πέτρος Στέφανος",
         ("greek", "f"): "Άννα Βασιλική Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία"}
SYLLABLES = {"latin": "bal cor den fal gor hal kem lin mar nor pel ros sal tor vin wes",
             "cyrillic": "бал вор ден кал лим мар нор пел рос сав тар фед хол шев",
             "greek": "βαλ γορ δελ καλ λιν μαρ νικ παπ ροδ στε ταρ φιλ"}
ENDING = {("latin", "m"): "er", ("latin", "f"): "er", ("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова",
          ("greek", "m"): "ης", ("greek", "f"): "η"}
SECRET_WORDS = "token|secret|password|passwd|api[_-]?key|access[_-]?key"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
_PHONE = r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_CARD = r"(?<![\d.-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4})(?![\d-]|\.\d)"
# ---- fixed values: first digits that card issuers use (public ranges); American Express has 15 digits
_ISSUER = (r"^(?:4|5[0-8]|2(?:2(?:2[1-9]|[3-9]\d)|[3-6]\d\d|7[01]\d|720)|220[0-4]|3[47]\d{13}$"
           r"|3(?:0[0-5]|[689]|5(?:2[89]|[3-8]\d))|6(?:011|2|304|4[4-9]|5|759|76[1-3])|81)")
_SECRET = rf"""["'](?<=(?i:{SECRET_WORDS})["']? ?[=:] ?["'])[A-Za-z0-9_+/=.-]{{16,}}+["']"""
# without quotes; a call or an index is code
_BARE_SECRET = rf"""(?<=(?i:{SECRET_WORDS})["']? ?[=:] ?)(?=[A-Za-z0-9_+/=.-])(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/=.-]{{16,}}+(?![(\[])"""
# ten digits without a country code; one number with its +1 form
_NATIONAL = r"(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4})"
_LOCAL_PHONE = rf"(?<![\p{{L}}\p{{N}}+.-])(?<!\d ){_NATIONAL}(?! ?\d|-\d|\.\d)"
_NAME = rf"(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
PATTERN = "|".join([_EMAIL, _PHONE, _SSN, _IP, _CARD, _LOCAL_PHONE, _SECRET, _BARE_SECRET, _NAME])
_HINT = rf"[0-9@]|(?:{_TITLE})|(?i:{SECRET_WORDS})"      # no entity without one of these


def entities(text: Column) -> Column:
    """All candidate entities of a text, in order."""
    return (F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
             .otherwise(F.array().cast("array<string>")))


def _number(digest: Column, i: Column) -> Column:
    """A byte of a hex digest, by position."""
    return F.conv(F.substr(digest, F.pmod(i * 2, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int") + i


def _pick(words: str, n: Column) -> Column:
    items = words.split()
    return F.element_at(F.array(*[F.lit(w) for w in items]), F.pmod(n, F.lit(len(items))) + 1)


def _letters(first: str, count: int) -> str:
    return " ".join(chr(ord(first) + k) for k in range(count))


def _scramble(text: Column, digest: Column, latin: int = 26) -> Column:
    """Replace every digit by another digit and every letter by one of its script."""
    def one(c: Column, i: Column) -> Column:
        n = _number(digest, i)
        return (F.when(c.rlike("[0-9]"), F.pmod(c.cast("int") + 1 + F.pmod(n, F.lit(9)), F.lit(10)).cast("string"))
                 .when(c.rlike(r"\p{IsCyrillic}"), _pick(_letters("а", 32), n))
                 .when(c.rlike(r"\p{IsGreek}"), _pick(_letters("α", 17), n))
                 .when(c.rlike(r"\p{IsLatin}"), _pick(_letters("a", latin), n))
                 .when(c.rlike(r"\p{IsHan}"), _pick(_letters("一", 64), n))
                 .when(c.rlike(r"\p{L}"), _pick(_letters("a", 26), n))
                 .when(c.rlike(r"\p{N}"), F.pmod(n, F.lit(10)).cast("string"))
                 .otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string (its last digit is the check digit)."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, F.when(
        c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _issuer_digits() -> Column:
    """How many first digits of a card's ``form`` its issuer is known by; any others may follow them."""
    return F.when(F.col("form").startswith("4"), 1).when(
        F.col("form").rlike("^(?:5|3[4789]|36|6[25]|81|2[3-6])"), 2).otherwise(4)


def _described(rows: DataFrame) -> DataFrame:
    """Add kind and canonical form of each ``raw`` entity; drop candidates that are none."""
    raw = F.col("raw")
    digits = F.regexp_replace(raw, "[^0-9]", "")
    kind = (F.when(raw.contains("@"), "email").when(raw.rlike(rf"^(?:\+[\d ().-]+|{_NATIONAL})$"), "phone")
             .when(raw.rlike("^[\"']"), "secret").when(raw.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
             .when(raw.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
             .when(raw.rlike(r"^[\d -]+$"), "card")
             .when(raw.rlike(r"^[A-Za-z0-9_+/=.-]{16,}$"), "secret").otherwise("name"))
    title = F.regexp_extract(raw, rf"^({_TITLE})\.? ", 1)
    script = (F.when(raw.rlike(r"\p{IsCyrillic}"), "cyrillic").when(raw.rlike(r"\p{IsGreek}"), "greek")
               .otherwise("latin"))
    gender = F.element_at(F.create_map(*[F.lit(x) for p in TITLES.items() for x in p]), title)
    name = F.regexp_replace(raw, rf"^(?:{_TITLE})\.? ", "")
    form = (F.when(F.col("kind") == "phone", F.concat(F.when(raw.startswith("+"), "+").otherwise("+1"), digits))
             .when(F.col("kind") == "secret", F.lower(F.regexp_replace(raw, "[\"']", "")))
             .when(F.col("kind").isin("card", "ssn"), digits)
             .when(F.col("kind") == "name", F.concat_ws("|", script, gender, name))
             .when(F.col("kind") == "ip", raw).otherwise(F.lower(raw)))
    return (rows.withColumn("kind", kind).withColumn("form", form)
                .where((F.col("kind") != "card") | ((_luhn_sum(digits) % 10 == 0) & digits.rlike(_ISSUER)))
                # nothing to replace in e-mails and secrets of punctuation only
                .where(~F.col("kind").isin("email", "secret")
                       | F.regexp_replace(raw, r"(?<=@.{0,256})\.\p{L}+$", "").rlike(r"[\p{L}\p{N}]")))


def _surrogate(key: str) -> Column:
    """Surrogate of ``form`` for draw number ``draw``, in canonical form."""
    form, kind = F.col("form"), F.col("kind")

    def digest(of: Column) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, of, F.col("draw").cast("string")), 256)
    own = digest(form)

    def syllable(script: str):
        return lambda i: _pick(SYLLABLES[script], _number(own, i))

    def at(i: int) -> Column:
        return F.conv(F.substr(own, F.lit(4 * i + 1), F.lit(4)), 16, 10).cast("int")
    local, domain = F.split_part(form, F.lit("@"), F.lit(1)), F.split_part(form, F.lit("@"), F.lit(2))
    top = F.regexp_extract(domain, r"\.[^.]+$", 0)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    of_domain = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256)
    email = F.concat(_scramble(local, own), F.lit("@"), _scramble(host, of_domain), top)
    code = F.when(form.startswith("+1"), 2).otherwise(3)
    phone = F.concat(F.substr(form, F.lit(1), code),
                     _scramble(F.substr(form, code + 1, F.length(form)), own))
    issuer = _issuer_digits()
    body = F.concat(F.substr(form, F.lit(1), issuer),
                    _scramble(F.substr(form, issuer + 1, F.length(form) - issuer - 1), own))
    card = F.concat(body, F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)),
                                 F.lit(10)).cast("string"))
    part = F.split(form, r"\.")

    def octet(i: int) -> Column:
        return (F.pmod(at(i), F.lit(254)) + 1).cast("string")
    first = F.pmod(at(0), F.lit(223)) + 1
    first = F.when(first.isin(10, 127, 172, 192), first + 1).otherwise(first).cast("string")
    ip = (F.when(part[0].isin("10", "127"), F.concat_ws(".", part[0], octet(1), octet(2), octet(3)))
           .when(form.startswith("192.168."), F.concat_ws(".", part[0], part[1], octet(2), octet(3)))
           .when((part[0] == "172") & part[1].cast("int").between(16, 31), F.concat_ws(
               ".", part[0], (F.pmod(at(1), F.lit(16)) + 16).cast("string"), octet(2), octet(3)))
           .otherwise(F.concat_ws(".", first, octet(1), octet(2), octet(3))))
    named = []
    for (script, gender), names in FIRST.items():
        # a longer family name with every draw, so distinct names never run out
        family = F.array_join(F.transform(F.sequence(F.lit(1), F.col("draw") + 3), syllable(script)), "")
        full = F.concat(_pick(names, at(15)), F.lit(" "), F.initcap(family), F.lit(ENDING[script, gender]))
        single = F.concat(F.initcap(family), F.lit(ENDING[script, gender]))
        named.append((form.startswith(f"{script}|{gender}|"),
                      F.concat(F.lit(f"{script}|{gender}|"), F.when(form.contains(" "), full).otherwise(single))))
    name = reduce(lambda c, x: c.when(*x), named[1:], F.when(*named[0]))
    return (F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card)
             .when(kind == "ip", ip).when(kind == "name", name)
             .when(form.rlike("^[0-9a-f]+$"), _scramble(form, own, 6)).otherwise(_scramble(form, own)))


def _space() -> Column:
    """What ``form`` shares with all values that may stand in its place."""
    form, kind = F.col("form"), F.col("kind")
    shape = form
    for letters, one in ((r"\p{IsLatin}", "a"), (r"\p{IsCyrillic}", "б"), (r"\p{IsGreek}", "γ"), (r"\p{IsHan}", "一"),
                         (r"[^\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{IsHan}\P{L}]", "x"), (r"\p{N}", "0")):
        shape = F.regexp_replace(shape, letters, one)
    ip = F.regexp_extract(form, r"^(10\.|127\.|192\.168\.|172\.(?=(?:1[6-9]|2\d|3[01])\.))", 1)
    return (F.when(kind == "ip", ip).when(kind == "name", F.concat(F.regexp_extract(form, r"^[^|]*\|[^|]*\|", 0),
                                                                  form.contains(" ").cast("string")))
             .when(kind == "email", F.concat(F.split_part(shape, F.lit("@"), F.lit(1)), F.lit("@"),
                                             F.split_part(form, F.lit("@"), F.lit(2))))
             .when(kind == "phone", F.concat(F.substr(form, F.lit(1), F.when(form.startswith("+1"), 2).otherwise(3)),
                                             F.length(form).cast("string")))
             .when(kind == "card", F.concat(F.substr(form, F.lit(1), _issuer_digits()), F.length(form).cast("string")))
             .otherwise(shape))


def _permuted(pending: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """Surrogates where a space is too dense to draw from: a keyed rotation of the values left in it.

    No drawn surrogate occurs as an entity, so the values left are free; a
    value left alone takes another one that occurs in its space.
    """
    order = Window.partitionBy("kind", "_space").orderBy(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "form"), 256))
    left = pending.select("kind", "form", _space().alias("_space"))
    turned = left.withColumn("_next", F.lead("form").over(order)).withColumn("_first", F.first("form").over(order))
    ends = forms.select("kind", "form", _space().alias("_space")).groupBy("kind", "_space").agg(
        F.min("form").alias("_min"), F.max("form").alias("_max"))
    other = F.when(F.col("_min") != F.col("form"), F.col("_min")).when(F.col("_max") != F.col("form"), F.col("_max"))
    turn = F.coalesce("_next", F.when(F.col("_first") != F.col("form"), F.col("_first")), other, F.raise_error(
        F.lit("no distinct surrogates left for a kind of entity")).cast("string"))
    return turned.join(ends, ["kind", "_space"]).select("kind", "form", turn.alias("surrogate"))


def surrogates(found: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, form, surrogate`` for distinct ``found(kind, form)``, all surrogates distinct."""
    forms = table(found.distinct(), "pii-forms")
    pending, done = forms.withColumn("draw", F.lit(0)), None
    for draw in range(MAX_DRAWS):
        drawn = pending.withColumn("surrogate", _surrogate(key))
        same = ["kind", "surrogate"]
        winner = drawn.groupBy(*same).agg(F.min("form").alias("form"))
        winner = winner.join(forms.select("kind", F.col("form").alias("surrogate")), same, "left_anti")
        if done is not None:
            winner = winner.join(done, same, "left_anti")
        winner = table(winner.select("kind", "form", "surrogate"), "pii-drawn")
        done = winner if done is None else done.unionByName(winner)
        pending = table(pending.join(winner, ["kind", "form"], "left_anti").withColumn("draw", F.col("draw") + 1),
                        "pii-pending")
        left = pending.count()
        if not left:
            return done
        if draw >= DENSE_DRAWS and winner.count() < left:      # less than half found a free value
            break
    return done.unionByName(table(_permuted(pending, forms, key), "pii-permuted"))


def _written() -> Column:
    """The surrogate in the format of ``raw``: punctuation and case kept."""
    raw, surrogate = F.col("raw"), F.col("surrogate")
    plain = F.regexp_replace(surrogate, r"[^\p{L}\p{N}]", "")
    national = (F.col("kind") == "phone") & ~raw.startswith("+")          # its form has a country code more
    plain = F.split(F.when(national, F.substr(plain, F.lit(2))).otherwise(plain), "")

    def one(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
        new = F.element_at(plain, at)
        return (F.when(~c.rlike(r"[\p{L}\p{N}]"), c)
                 .when((F.upper(c) == c) & (F.lower(c) != c), F.upper(new)).otherwise(new))
    same = F.array_join(F.transform(F.split(raw, ""), one), "")
    title = F.regexp_extract(raw, rf"^(?:{_TITLE})\.? ", 0)
    return (F.when(F.col("kind") == "name", F.concat(title, F.regexp_replace(surrogate, r"^[^|]*\|[^|]*\|", "")))
             .when(F.col("kind") == "ip", surrogate).otherwise(same))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as it takes to be new."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, plus, as the last column, ``n_entities`` (replaced, repeats counted).

    All columns of ``docs`` pass, whatever their names: if one is called ``n_entities``, the new one gets an underscore more.
    """
    columns = docs.columns
    counted = free_name("n_entities", columns)
    row = F.struct(*[docs[c] for c in columns])
    # texts are searched once; rows and what was found in them are written and read from there
    cut = table(docs.select(row.alias("row"), entities(docs["text"].cast("string")).alias("found"),
                            F.xxhash64(docs["text"].cast("string")).alias("key")), "pii-scanned")
    plain = cut.where(F.coalesce(F.size("found"), F.lit(0)) <= 0).select(
        *[F.col(f"row.`{c}`").alias(c) for c in columns], F.lit(0).cast("long").alias(counted))
    hit = cut.where(F.size("found") > 0)
    mention = hit.select("key", F.explode(F.array_distinct("found")).alias("raw")).distinct()
    mention = table(_described(mention), "pii-mentions")
    chosen = surrogates(mention.select("kind", "form"), key)
    written = mention.join(chosen, ["kind", "form"]).select("key", "raw", _written().alias("new"))
    maps = written.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("new"))
    pieces = F.split(F.col("row.text"), PATTERN, -1)
    between = F.concat(F.transform("found", lambda e: F.coalesce(F.element_at("new", e), e)), F.array(F.lit("")))
    text = F.array_join(F.flatten(F.zip_with(pieces, between, lambda p, e: F.array(p, e))), "")
    count = F.size(F.filter("found", lambda e: F.element_at("new", e).isNotNull())).cast("long")
    known = F.col("new").isNotNull()
    changed = hit.join(maps, "key", "left").select(
        *[(F.when(known, text).otherwise(F.col("row.text")) if c == "text" else F.col(f"row.`{c}`")).alias(c)
          for c in columns], F.when(known, count).otherwise(F.lit(0)).cast("long").alias(counted))
    return plain.unionByName(changed)
