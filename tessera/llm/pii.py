"""Personal data replaced by keyed surrogates (operator 9), in DataFrame functions only.

Entities are found by patterns: e-mail addresses, secrets (keys, tokens, passwords, hexadecimal
runs of 24 digits or more), phone numbers (with + or 00 and country code, or national with area
code), card, bank and social security numbers, IPv4 and IPv6 addresses, and names: after a title
any number of words with hyphens, apostrophes, inner capitals, initials and particles, and
without one what begins with a given name of MALE_NAMES or FEMALE_NAMES and goes on in capitals.
In a document with a name its words are also replaced where they stand alone, by the same
surrogate; persons that a document gives neither a title nor such a name are not found.

A surrogate has the entity's type and format: digits stay digits, letters keep case and script,
separators, country codes, key prefixes, top-level domains, titles and particles stay, card and
bank numbers get valid check digits, and given names one of the person's gender. It follows by
HMAC-SHA256 from a secret key and the entity's canonical form (case, spacing and punctuation
aside), so every mention of an entity gets the same surrogate, in every document and in whatever
format it is written. A name goes word by word: "Mr Smith" and "John Smith" share a family name.

Two entities must not get one surrogate, and no surrogate may be an entity that occurs. All
distinct entities (of names: the words, by role) are checked for both; those in the way draw
again with a higher attempt number, and are checked against all that is settled, until none is
left. From attempt WIDEN on a surrogate is longer than its entity by one more place each time, so
that a format with more entities than values runs out of attempts neither. Only documents with
such entities are joined with the table of attempts.

Patterns repeat without recursion and each character is looked at a bounded number of times, so
very long texts and entities (beyond LONG characters an entity is drawn in pieces) take time in
proportion. Null texts stay null, documents without entities stay as they are, repeated rows are
treated alike, an empty table gives an empty result, all other columns are carried along under
any names; an input column with the name of an added one is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, written

KINDS = ("email", "secret", "ip", "phone", "iban", "ssn", "card", "name")
#: Attempts in the entity's own length, and characters of an entity that are drawn one by one.
WIDEN, LONG = 3, 128

#: Titles by gender (fixed values).
MALE, FEMALE, EITHER = "Mr|Herr|Monsieur|Señor", "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora", "Dr|Prof"
TITLES = f"{MALE}|{FEMALE}|{EITHER}"
#: Small words inside of names (fixed values).
PARTICLES = "von|van|der|den|de|del|della|du|di|da|dos|la|le|zu|ten|ter|bin|al|el"
#: Frequent given names by gender, that are seldom other words (fixed values).
MALE_NAMES = (
    "Alexander|Andreas|Andrew|Anthony|Antonio|Arthur|Benjamin|Bernd|Carlos|Charles|Christian|Christopher|Daniel|David|Dieter|Dmitri|Edward|Fernando|François|Georg|George|Hans|Heinrich|Helmut|Henri|Ivan|"
    "Jacques|James|Javier|Jean|Jens|Johann|John|Jonathan|Jorge|Joseph|José|Juan|Jürgen|Karl|Kenneth|Kevin|Klaus|Lukas|Manuel|Markus|Martin|Matthew|Michael|Miguel|Nicolas|Patrick|Paul|Pedro|Peter|Philip|"
    "Pierre|Rafael|Ralf|Richard|Robert|Roger|Ronald|Sergei|Stefan|Stephen|Steven|Thomas|Timothy|Ulrich|Vladimir|Walter|Werner|William|Wolfgang"
)
FEMALE_NAMES = (
    "Alexandra|Alice|Amanda|Andrea|Angela|Anna|Anne|Barbara|Beatriz|Birgit|Brigitte|Carmen|Carolina|Catherine|Charlotte|Christina|Claire|Claudia|Cristina|Deborah|Elena|Elisabeth|Elizabeth|Emily|Emma|Eva|"
    "Francesca|Gabriele|Giulia|Hannah|Heike|Helen|Helena|Ingrid|Irina|Isabel|Jane|Jennifer|Jessica|Johanna|Julia|Karen|Karin|Katharina|Laura|Linda|Lisa|Lucia|Magdalena|Margaret|Maria|Marie|Martina|Mary|"
    "Melissa|Michelle|Monika|Natalia|Nathalie|Nicole|Olga|Patricia|Petra|Rebecca|Renate|Sabine|Samantha|Sandra|Sarah|Sophie|Stephanie|Susan|Susanne|Svetlana|Teresa|Ursula|Valentina|Veronica|Victoria"
)
#: Parts of drawn given names: consonants, vowels, and endings by gender (fixed values).
CONSONANTS, VOWELS = "bdfgjklmnprstvz", "aeiou"
ENDINGS = {"m": ("o", "us", "er", "ian"), "f": ("a", "ia", "ina", "elle"), "n": ("y", "is", "en", "il")}
#: Letters of the scripts beside Latin (fixed values).
CYRILLIC, GREEK = "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_SECRET = r"(?i:(?<![\p{L}\p{N}])(?:token|password|passwd|pwd|secret|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?)"
_SMALL = rf"(?:(?:{PARTICLES}) )*+"
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]|(?!['’]s(?!\p{L}))['’-](?=\p{L}))++"
_NAMED = rf"{_SMALL}(?:{_WORD}|\p{{Lu}}\.?(?= {_SMALL}\p{{Lu}}))"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEXTET = "[0-9a-fA-F]{1,4}"
#: At most 7 colons; mixed forms first, since the others match their beginning.
_IPV6 = (
    rf"(?<![\p{{L}}\p{{N}}])(?!(?:[0-9a-fA-F]*:){{8}})(?:(?:{_HEXTET}:){{6}}{_IPV4}|(?:{_HEXTET}(?::{_HEXTET}){{0,5}}|(?<!:))::(?:{_HEXTET}:){{0,5}}{_IPV4}"
    rf"|(?:{_HEXTET}:){{7}}{_HEXTET}|{_HEXTET}(?::{_HEXTET}){{0,6}}::(?:{_HEXTET}(?::{_HEXTET}){{0,6}})?|(?<!:)::{_HEXTET}(?::{_HEXTET}){{0,6}})(?![\p{{L}}\p{{N}}]|:[\p{{L}}\p{{N}}:])"
)
#: Not dates, social security and card numbers.
_OTHERS = r"(?!\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d{2}(?!\d)|\d{3}-\d{2}-\d{4}(?![\d-])|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d))"
_PHONES = (
    r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}",
    r"00[1-9][0-9]{0,2}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}",
    r"\([0-9]{2,5}\)[ ./-]?[0-9]{3,4}[ .-]?[0-9]{3,5}",
    r"\(0[0-9]{1,4}\)(?:[ ./-]?[0-9]{2,4}){2,4}",
    _OTHERS + r"(?=(?:[ ./-]?[0-9]){9,13}(?![0-9]))0[1-9][0-9]{0,4}(?:[ ./-][0-9]{2,8}){1,4}",
    r"0[1-9][0-9]{8,10}",
    r"(?:1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}",
)
_PHONE = rf"(?:{_PHONES[0]}|(?<![\p{{L}}\p{{N}}])(?<!\p{{N}}[.,/-])(?:{'|'.join(_PHONES[1:])}))(?![0-9])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": _SECRET + r"[^\s\"'!,;]{6,}|\bAKIA[0-9A-Z]{16}\b|(?<![\p{L}\p{N}])(?=[a-fA-F]*\d)(?=\d*[a-fA-F])[0-9a-fA-F]{24,}+(?![\p{L}\p{N}])",
    "ip": rf"{_IPV6}|(?<![\d.]){_IPV4}(?!\d|\.\d)",
    "phone": _PHONE,
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)",
    "name": rf"\b(?=\p{{Lu}})(?:(?:(?:{TITLES})\.? )++{_NAMED}(?: {_NAMED})*+|(?:{MALE_NAMES}|{FEMALE_NAMES})(?: {_NAMED})++)",
}
_NAMING = rf"\b(?=\p{{Lu}})(?:(?:{TITLES})\.?|{MALE_NAMES}|{FEMALE_NAMES}) {_SMALL}\p{{Lu}}"
_TITLE = rf"^((?:(?:{TITLES})\.? )++)"
#: A name by itself, and not only words of one found elsewhere in its text.
_WHOLE = rf"^(?:(?:{TITLES})\.? |(?:{MALE_NAMES}|{FEMALE_NAMES}) )"
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def may_hold(text: Column) -> Column:
    """Whether a text has what every entity needs: a digit, an @, a key prefix, a key word with its sign, colons as in an address, or a title or given name before a name."""
    sign = (text.contains("=") | text.contains(":")) & text.rlike(_SECRET)
    colons = text.contains("::") | (text.contains(":") & text.rlike("(?:[a-fA-F]{1,4}:){6}"))
    return text.contains("@") | colons | text.rlike("[0-9]") | text.contains("AKIA") | sign | text.rlike(_NAMING)


def mentions(text: Column) -> Column:
    """All entities of a text in order, as written; texts that can't hold any are looked at in cheaper ways only."""
    return F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def name_words(found: Column) -> Column:
    """The words of the names among the mentions of a text, also in capitals, longest first; no initials and particles."""
    bodies = F.transform(F.filter(found, lambda m: m.rlike(_WHOLE) & (kind_of(m) == "name")), lambda m: F.split(F.regexp_replace(m, _TITLE, ""), " "))
    words = F.filter(F.flatten(bodies), lambda w: w.rlike(rf"^{_WORD}$"))
    sized = F.transform(F.array_union(words, F.transform(words, F.upper)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return F.transform(F.sort_array(sized, asc=False), lambda x: x["w"])


def pattern_with(words: Column) -> Column:
    """The pattern of all entities and of runs of ``words``, which need no quoting."""
    one = F.concat(F.lit("(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?=\p{Lu})"), one, F.lit("(?: "), one, F.lit(")*+"))


def kind_of(m: Column) -> Column:
    """The kind of a mention."""
    out = F.when(m.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for kind in KINDS[1:-1]:
        out = out.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("name")


def _prefix(m: Column, kind: Column) -> Column:
    """What of a mention stays before the entity itself."""
    title, key = F.regexp_extract(m, _TITLE, 1), F.regexp_extract(m, f"^({_SECRET}|AKIA)", 1)
    return F.when(kind == "secret", key).when(kind == "name", title).otherwise("")


def _address(m: Column) -> Column:
    """An IP address in its longest form, in lower case; mixed forms as written."""
    groups = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")
    sides = F.split(F.lower(m), "::")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
    whole = F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ":")
    return F.when(m.contains(":") & ~m.contains("."), whole).otherwise(F.lower(m))


def canonical(m: Column, kind: Column) -> Column:
    """What all mentions of an entity have in common; m: a mention, or a word of a name (other kinds than KINDS)."""
    digits, compact = F.regexp_replace(m, r"\D", ""), F.upper(F.regexp_replace(m, r"[^\p{L}\p{N}]", ""))
    abroad = F.concat(F.lit("+"), F.regexp_replace(digits, "^00", ""))
    secret = F.lower(F.regexp_replace(m, f"^(?:{_SECRET}|AKIA)", ""))
    out = F.when(kind == "secret", secret).when(kind == "ip", _address(m)).when(kind == "iban", compact)
    return out.when(kind == "phone", F.when(m.rlike(r"^(?:\+|00)"), abroad).otherwise(digits)).when(kind.isin("card", "ssn"), digits).otherwise(F.lower(m))


def _hmac(key: str, told: Column) -> Column:
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in secret)), F.encode(told, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in secret)), F.unhex(inner)), 256)


def _stream(key: str, *parts: Column) -> Column:
    """128 keyed hexadecimal digits."""
    told = F.concat_ws("\x1f", *parts)
    return F.concat(_hmac(key, told), _hmac(key, F.concat(told, F.lit("\x1f+"))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(stream.substr((i % 64 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _like(m: Column, stream: Column) -> Column:
    """A string of the format of ``m``: its letters and digits drawn anew in their class by their place, the rest as it is.

    Beyond LONG characters all are letters, or hexadecimal digits if all of ``m`` are.
    """

    def drawn(c: Column, r: Column, hexadecimal: Column) -> Column:
        small = F.when(hexadecimal, F.char(97 + r % 6)).when(c.rlike(r"\p{IsCyrillic}"), F.lit(CYRILLIC).substr(r % len(CYRILLIC) + 1, F.lit(1))).when(c.rlike(r"\p{IsGreek}"), F.lit(GREEK).substr(r % len(GREEK) + 1, F.lit(1))).otherwise(F.char(97 + r % 26))
        return F.when(c.rlike(r"\p{N}"), (r % 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(small)).otherwise(small)

    def letter(c: Column, i: Column, hexadecimal: Column) -> Column:
        return F.when(c.rlike(r"[\p{L}\p{N}]"), _let(_byte(stream, i), lambda r: drawn(c, r, hexadecimal))).otherwise(c)

    def rest(hexadecimal: Column) -> Column:
        n = F.length(m) - LONG
        pieces = F.transform(F.sequence(F.lit(0), F.ceil(n / 64).cast("int") - 1), lambda i: F.sha2(F.concat(stream, i.cast("string")), 256))
        raw = F.array_join(pieces, "").substr(F.lit(1), n)
        told = F.when(hexadecimal, raw).otherwise(F.translate(raw, "0123456789", "ghijklmnop"))
        return F.when(n <= 0, "").when(m == F.upper(m), F.upper(told)).otherwise(told)

    def whole(h: Column) -> Column:
        return F.concat(F.array_join(F.transform(F.split(m.substr(1, LONG), ""), lambda c, i: letter(c, i, h)), ""), rest(h))

    return F.when(F.length(m) > 0, _let(m.rlike("^[0-9a-fA-F]++$"), whole)).otherwise("")


def _laid(m: Column, compact: Column) -> Column:
    """``compact`` in the separators of ``m``, a number of bounded length; what is left over follows."""

    def char(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(m.substr(F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
        return F.when(c.rlike(r"[\p{L}\p{N}]"), compact.substr(before, F.lit(1))).otherwise(c)

    own = F.length(F.regexp_replace(m, r"[^\p{L}\p{N}]", ""))
    return F.concat(F.array_join(F.transform(F.split(m, ""), char), ""), compact.substr(own + 1, F.length(compact)))


def _more(stream: Column, attempt: Column, letters: bool) -> Column:
    """The characters by which a surrogate is longer than its entity."""
    n = attempt - (WIDEN - 1)
    each = lambda i: F.char(97 + _byte(stream, 63 - i) % 26) if letters else (_byte(stream, 63 - i) % 10).cast("string")
    return F.when(n <= 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), each), ""))


def _checked_card(payload: Column) -> Column:
    """The digits with their Luhn digit."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.split(F.reverse(payload), ""), value), F.lit(0), lambda a, x: a + x)
    return F.concat(payload, F.pmod(-total, F.lit(10)).cast("string"))


def _checked_iban(country: Column, rest: Column) -> Column:
    """The account with its check digits (ISO 7064, modulus 97)."""

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    mod = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), step)
    return F.concat(country, F.lpad((98 - mod).cast("string"), 2, "0"), rest)


def _number(m: Column, kind: Column, stream: Column, more: Column) -> Column:
    """The surrogate of a phone, bank, card or social security number: its digits by the entity's, laid out as the mention."""
    compact = F.upper(F.regexp_replace(m, r"[^\p{L}\p{N}]", ""))
    kept = F.when(compact.startswith("00"), F.when(compact.rlike("^00[17]"), 3).otherwise(4)).when(m.startswith("+"), F.when(compact.rlike("^[17]"), 1).otherwise(2))
    kept = kept.when(compact.startswith("0") | compact.rlike("^1.{10}$"), 1).otherwise(0)
    phone = _let(kept, lambda n: F.concat(compact.substr(F.lit(1), n), _like(compact.substr(n + 1, F.length(compact)), stream), more))
    card = _checked_card(F.concat(compact.substr(1, 1), _like(compact.substr(F.lit(2), F.length(compact) - 2), stream), more))
    iban = _let(_like(compact.substr(F.lit(5), F.length(compact)), stream), lambda b: _checked_iban(compact.substr(1, 2), F.concat(b, more)))
    drawn = F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).otherwise(F.concat(_like(compact, stream), more))
    return _let(drawn, lambda d: _laid(m, d))


def _one_of(values: Sequence[str], r: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), r % len(values))


def _given(w: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    """A given name of the gender for a Latin word, longer by a syllable for each attempt from WIDEN on; else letters of the word's script."""
    consonant, vowel = (lambda i: _one_of(CONSONANTS, _byte(stream, i))), (lambda i: _one_of(VOWELS, _byte(stream, i)))
    n = F.greatest(attempt - (WIDEN - 2), F.lit(1))
    syllables = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(consonant(i * 2), vowel(i * 2 + 1))), "")
    r = _byte(stream, F.lit(62))
    end = F.when(gender == "m", _one_of(ENDINGS["m"], r)).when(gender == "f", _one_of(ENDINGS["f"], r)).otherwise(_one_of(ENDINGS["n"], r))
    name = _let(F.concat(syllables, consonant(F.lit(63)), end), lambda x: F.when(w == F.upper(w), F.upper(x)).otherwise(F.initcap(x)))
    return F.when(w.rlike(r"^[\p{IsLatin}'’-]++$"), name).otherwise(F.concat(_like(w, stream), _more(stream, attempt, True)))


def _initial(w: Column, key: str) -> Column:
    """A capital of the Latin alphabet moved on by a keyed number of places: distinct ones stay distinct."""
    shift = 1 + hashlib.sha256(b"initial\x1f" + key.encode()).digest()[0] % 25
    moved = F.char(65 + (F.ascii(w) - 65 + shift) % 26)
    return F.when(w.rlike("^[A-Z]"), F.concat(moved, w.substr(F.lit(2), F.length(w)))).otherwise(_let(_stream(key, F.lit("initial"), F.lower(w)), lambda s: _like(w, s)))


def _words(body: Column, prefix: Column) -> Column:
    """(w, role) of each word of a name; role: "family" for the last, else the given name's gender, "initial", or "" for particles."""
    male = prefix.rlike(rf"\b(?:{MALE})\b") | (~prefix.rlike(rf"\b(?:{FEMALE})\b") & body.rlike(f"^(?:{MALE_NAMES}) "))
    female = prefix.rlike(rf"\b(?:{FEMALE})\b") | body.rlike(f"^(?:{FEMALE_NAMES}) ")
    gender = F.when(male, "m").when(female, "f").otherwise("n")
    role = lambda w, i, n, g: F.when(w.rlike(rf"^(?:{PARTICLES})$"), "").when(w.rlike(r"^\p{Lu}\.?$"), "initial").when(i < n - 1, g).otherwise("family")
    return _let(F.split(body, " "), lambda ws: _let(gender, lambda g: F.transform(ws, lambda w, i: F.struct(w.alias("w"), role(w, i, F.size(ws), g).alias("role")))))


def parsed(found: Column) -> Column:
    """(m, kind, prefix, body, entity, words) of each mention of an array; words of names only, entity of others only."""
    kinds = F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    cut = F.transform(kinds, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _prefix(x["m"], x["kind"]).alias("prefix")))
    rest = F.transform(cut, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["prefix"].alias("prefix"), x["m"].substr(F.length(x["prefix"]) + 1, F.length(x["m"])).alias("body")))
    words = lambda x: F.when(x["kind"] == "name", _words(x["body"], x["prefix"]))
    entity = lambda x: F.when(x["kind"] != "name", canonical(x["m"], x["kind"]))
    return F.transform(rest, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["prefix"].alias("prefix"), x["body"].alias("body"), entity(x).alias("entity"), words(x).alias("words")))


def units(found: Column) -> Column:
    """(kind, entity, form) of all that surrogates are drawn for in an array of mentions: the entity, or the words of a name by role."""
    of_name = lambda x: F.transform(F.filter(x["words"], lambda w: ~w["role"].isin("", "initial")), lambda w: F.struct(w["role"].alias("kind"), F.lower(w["w"]).alias("entity"), w["w"].alias("form")))
    alone = lambda m: (kind_of(m) == "name") & ~m.rlike(_WHOLE)
    each = F.transform(parsed(F.filter(found, lambda m: ~alone(m))), lambda x: F.when(x["kind"] == "name", of_name(x)).otherwise(F.array(F.struct(x["kind"].alias("kind"), x["entity"].alias("entity"), x["m"].alias("form")))))
    return F.flatten(each)


def unit_surrogate(form: Column, kind: Column, entity: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a unit as its form is written."""

    def by(stream: Column) -> Column:
        letters, digits = _more(stream, attempt, True), _more(stream, attempt, False)
        domain, top = F.regexp_extract(form, r"@(.*)\.[^.]*$", 1), F.regexp_extract(form, r"(\.[^.]*)$", 1)
        host = _let(domain, lambda d: _let(_stream(key, F.lit("domain"), F.lower(d)), lambda s: _like(d, s)))
        mail = F.concat(_let(F.regexp_extract(form, "^([^@]*)@", 1), lambda n: _like(n, stream)), letters, F.lit("@"), host, top)
        short = F.concat_ws(".", *[(_byte(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
        long = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: stream.substr(i * 4 + 1, F.lit(4))), ":")
        address = F.when(form.contains(":") | (attempt >= WIDEN), long).otherwise(short)
        prefix = F.regexp_extract(form, f"^({_SECRET}|AKIA)", 1)
        secret = _let(form.substr(F.length(prefix) + 1, F.length(form)), lambda b: F.concat(prefix, _like(b, stream), letters))
        family = F.concat(_like(form, stream), F.when(form == F.upper(form), F.upper(letters)).otherwise(letters))
        out = F.when(kind == "email", mail).when(kind == "ip", address).when(kind == "secret", secret).when(kind == "family", family)
        return out.when(kind.isin("m", "f", "n"), _given(form, kind, stream, attempt)).otherwise(_number(form, kind, stream, digits))

    return _let(_stream(key, kind, entity, attempt.cast("string")), by)


def replaced(x: Column, key: str, attempt_of: Callable[[Column, Column], Column]) -> Column:
    """The surrogate of a parsed mention."""

    def word(w: Column) -> Column:
        drawn = unit_surrogate(w["w"], w["role"], F.lower(w["w"]), key, attempt_of(w["role"], F.lower(w["w"])))
        return F.when(w["role"] == "", w["w"]).when(w["role"] == "initial", _initial(w["w"], key)).otherwise(drawn)

    person = F.concat(x["prefix"], F.array_join(F.transform(x["words"], word), " "))
    return F.when(x["kind"] == "name", person).otherwise(unit_surrogate(x["m"], x["kind"], x["entity"], key, attempt_of(x["kind"], x["entity"])))


def surrogate(m: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a mention, all of its units at one attempt."""
    return F.get(F.transform(parsed(F.array(m)), lambda x: replaced(x, key, lambda kind, entity: attempt)), F.lit(0))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, entity, form: every distinct unit with one of its forms; mentions are counted together before the shuffle."""
    every = docs.select(F.explode(mentions(F.col(text_col).cast("string"))).alias("mention"))
    named = every.groupBy("mention").count().select(F.inline(units(F.array("mention"))))
    return named.groupBy("kind", "entity").agg(F.min("form").alias("form"))


def _space(kind: Column) -> Column:
    """Given names of all genders share their values."""
    return F.when(kind.isin("m", "f", "n"), "given").otherwise(kind)


def attempts(found: DataFrame, key: str) -> DataFrame:
    """kind, entity, attempt for the units whose first surrogates won't do (attempt over 0).

    Each round draws for what is open only, and holds it against the real entities, what is
    settled and itself. Rounds end, because from WIDEN on every one has more values to draw from.
    """
    known = written(found, "pii-entities")
    taken = known.select(_space(F.col("kind")).alias("space"), F.col("entity").alias("as"))
    open_, raised, n = known, None, 0
    while True:
        new = unit_surrogate(F.col("form"), F.col("kind"), F.col("entity"), key, F.lit(n))
        drawn = open_.select("kind", "entity", "form", _space(F.col("kind")).alias("space"), new.alias("new"))
        drawn = written(drawn.select("kind", "entity", "form", "space", canonical(F.col("new"), F.col("kind")).alias("as")), f"pii-drawn-{n}")
        hit = taken.join(drawn.select("space", "as").distinct(), ["space", "as"], "left_semi").distinct().withColumn("hit", F.lit(True))
        first = drawn.groupBy("space", "as").agg(F.min(F.struct("kind", "entity")).alias("holder"))
        judged = drawn.join(first, ["space", "as"]).join(hit, ["space", "as"], "left")
        judged = written(judged.withColumn("bad", F.coalesce("hit", F.lit(False)) | (F.struct("kind", "entity") != F.col("holder"))), f"pii-judged-{n}")
        if n:
            own = judged.where("NOT bad").select("kind", "entity", F.lit(n).alias("attempt"))
            raised = own if raised is None else raised.unionByName(own)
        taken = taken.unionByName(judged.where("NOT bad").select("space", "as"))
        open_ = judged.where("bad").select("kind", "entity", "form")
        if open_.isEmpty():
            return raised if raised is not None else known.select("kind", "entity", F.lit(0).alias("attempt")).limit(0)
        n += 1


def _untitled(m: Column, titled: Column) -> Column:
    """What the words of a name that stand alone became in the names (words, new) of their text; a name of the same words comes first."""

    def word(w: Column, names: Column) -> Column:
        of = F.get(F.filter(names, lambda t: F.array_contains(t["words"], F.lower(w))), F.lit(0))
        new = _let(of, lambda t: F.get(t["new"], F.array_position(t["words"], F.lower(w)).cast("int") - 1))
        return F.when(w == F.upper(w), F.upper(new)).otherwise(new)

    names = F.concat(F.filter(titled, lambda t: F.array_join(t["words"], " ") == F.lower(m)), titled)
    return _let(names, lambda n: F.array_join(F.transform(F.split(m, " "), lambda w: word(w, n)), " "))


def _rebuilt(text: Column, found: Column, words: Column, attempt_of: Callable[[Column, Column], Column], key: str) -> Column:
    whole = lambda x: (x["kind"] != "name") | x["m"].rlike(_WHOLE)
    drawn = F.transform(parsed(found), lambda x: F.struct(x.alias("x"), F.when(whole(x), replaced(x, key, attempt_of)).alias("new")))

    def settled(each: Column) -> Column:
        names = F.filter(each, lambda y: (y["x"]["kind"] == "name") & y["new"].isNotNull())
        titled = F.transform(names, lambda y: F.struct(F.split(F.lower(y["x"]["body"]), " ").alias("words"), F.split(y["new"].substr(F.length(y["x"]["prefix"]) + 1, F.length(y["new"])), " ").alias("new")))
        return _let(titled, lambda t: F.transform(each, lambda y: F.coalesce(y["new"], _untitled(y["x"]["m"], t))))

    new = _let(drawn, settled)
    # the last piece has no mention after it
    pieces = F.when(F.size(words) > 0, F.split(text, pattern_with(words), -1)).otherwise(F.split(text, ENTITY, -1))
    together = F.concat_ws("", F.flatten(F.transform(F.arrays_zip(pieces.alias("piece"), new.alias("new")), lambda z: F.array(z["piece"], z["new"]))))
    return F.when(F.size(found) > 0, together).otherwise(text)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with all entities of the text replaced, and n_entities, the number of mentions."""
    raised = attempts(entities(docs, text_col), key)
    pack = packed(docs, text=text_col)
    text = F.col("text").cast("string")
    plain = pack.frame.withColumn("plain", F.coalesce(mentions(text), F.array().cast("array<string>")))
    words = plain.withColumn("words", name_words(F.col("plain")))
    found = words.withColumn("found", F.when(F.size("words") > 0, F.regexp_extract_all(text, pattern_with(F.col("words")), F.lit(0))).otherwise(F.col("plain"))).drop("plain")
    attempt_of: Callable[[Column, Column], Column] = lambda kind, entity: F.lit(0)
    if not raised.isEmpty():
        found = written(found.withColumn("number", F.monotonically_increasing_id()), "pii-found")
        each = found.select("number", F.explode(F.array_distinct(F.transform(units(F.col("found")), lambda u: F.struct(u["kind"].alias("kind"), u["entity"].alias("entity"))))).alias("u"))
        held = each.select("number", "u.*").join(raised, ["kind", "entity"])
        of_row = held.groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "entity"), "attempt"))).alias("attempts"))
        found = found.join(of_row, "number", "left")
        attempt_of = lambda kind, entity: F.coalesce(F.col("attempts")[F.concat_ws("\x1f", kind, entity)], F.lit(0))
    new = _rebuilt(text, F.col("found"), F.col("words"), attempt_of, key)
    return pack.restored(found.withColumn("text", new), {"n_entities": F.size("found")})
