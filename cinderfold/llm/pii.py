"""Personal data replaced by surrogates of the same kind, gender, script and format.

A surrogate comes from a keyed permutation of all strings of the entity's format, so that equal entities get equal
surrogates everywhere (coreference) and different entities different ones (distinctness). The permutation is one cycle: no
entity maps to itself. Where an image would fall outside of the entity's class (a card number without its check digit, a
name of the lists, a token of digits alone), the cycle is walked on to the next string inside; classes are dense, so that
takes few steps. A collision check over the corpus then finds surrogates that equal another real entity; their entities
take the image under the next permutation that equals neither a real entity nor another surrogate (`exceptions`).

Formats, not words, make an entity: mail and IP addresses, telephone, social security, bank account and card numbers,
hexadecimal digests, what follows a word like `password` and `=` or `:`, and names behind a title or a listed given name.
A bare run of 13 to 19 digits is a card number if its Luhn check digit is right, and left alone if not.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderfold.llm.common import in_batches, load, row_key, written

#: Setting of the session that names the secret key.
KEY_SETTING = "spark.cinderfold.pii.key"
LEAST_KEY = 16
#: Entities whose surrogate collides go through so many more permutations.
ROUNDS = 8
CHUNK = 128
_DRAWN = secrets.token_bytes(32)


def key_of(spark: SparkSession) -> bytes:
    """The key that the session names; without one, a key drawn for this process, so that none is ever known or the same twice.

    Name a key to get the same surrogates in every application.
    """
    named = spark.conf.get(KEY_SETTING, None)
    return _checked(named.encode()) if named is not None else _DRAWN


def _checked(key: bytes) -> bytes:
    if len(key) < LEAST_KEY:
        raise ValueError(f"the key of surrogates needs {LEAST_KEY} bytes or more")
    return key


_DOMAIN = re.compile(r"(?:[\w-]+\.)+[A-Za-z][\w-]*")
_LOCAL = re.compile(r"[\w.+%-]")
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NUMBER = re.compile(
    rf"""(?<![\w@+])(?:
      (?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?![\w]|\.[0-9])
    | (?P<ssn>[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})(?![\w-])
    | (?P<card>[0-9]{{4}}(?P<gap>[ -])[0-9]{{4}}(?P=gap)[0-9]{{4}}(?P=gap)[0-9]{{1,7}})(?!\w)
    | (?P<phone>\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?[0-9]{{2,4}}){{1,4}}
              | \([0-9]{{3}}\)[ ]?[0-9]{{3}}[ .-][0-9]{{4}}
              | (?:1[ .-])?[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}})(?!\w)
    | (?P<iban>[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?)(?!\w)
    | (?P<hex>(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}))(?!\w)
    | (?P<digits>[0-9]{{13,19}})(?!\w)
    )""",
    re.VERBOSE,
)
_PHONE_START = re.compile(r"\+[0-9]")
#: One of these, in lower case, is in every match of _SECRET.
_SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "akia", "ghp_", "sk-")
_SECRET = re.compile(r"""(?i:\b(?:token|secret|password|passwd|pwd|(?:api|access|private|secret)[_ -]?key)["']?\s*[=:]\s*["']?)(?P<value>[\w+/=.~-]{6,})|\b(?P<known>AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})""")
#: Titles and what they say of gender. Fixed values.
TITLES = {"Mr": "m", "Sir": "m", "Herr": "m", "Señor": "m", "Sr": "m", "Monsieur": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Madame": "f", "Mme": "f", "Dr": "", "Prof": ""}
#: Given names, by gender; a listed name is replaced by another of its list, wherever it stands.
GIVEN = {
    "f": "Anna Carmen Charlotte Claire Elena Emily Emma Hannah Heidi Isabel Julia Julie Laura Lucia Marie Mary Nina Olivia Petra Rosa Sarah Sofia Susan Ursula".split(),
    "m": "Andreas Antonio Carlos Daniel David Diego Felix Hans Henry Jacques James John Jorge Karl Louis Lukas Martin Michael Miguel Paul Pedro Peter Pierre Thomas".split(),
}
_LISTED = {n.lower(): g for g, names in GIVEN.items() for n in names}
_PART = r"[^\W\d_a-z][^\W\d_A-Z]+"
_CAPITAL = rf"(?:[^\W\d_a-z]['’])?{_PART}(?:-{_PART})*"
_ANY = lambda names: "|".join(sorted(names, key=len, reverse=True))
_TITLED = re.compile(rf"\b(?P<title>{_ANY(TITLES)})(?:\. ?| )(?P<a>{_CAPITAL})(?: (?P<b>{_CAPITAL}))?")
_UNTITLED = re.compile(rf"\b(?P<a>{_ANY(n for names in GIVEN.values() for n in names)}) (?P<b>{_CAPITAL})")
_WORD = re.compile(r"\w+")
_PARTS = re.compile(r"\w{2,}")

_DIGITS, _VOWELS, _CONSONANTS = "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Alphabets of scripts, each in lower case: a letter is replaced by one of its own.
_SCRIPTS = ("abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöùúûüý", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя")
_BLOCK = 128


@lru_cache(maxsize=1 << 12)
def alphabet(c: str) -> str:
    """What may stand for a character: its script's letters; else those of its category in its block of 128 code points.

    Marks that are neither letters nor digits stand for themselves.
    """
    for known in (_DIGITS, *_SCRIPTS):
        if c in known:
            return known
    if not c.isalnum():
        return c
    first = ord(c) // _BLOCK * _BLOCK
    return "".join(x for x in map(chr, range(first, first + _BLOCK)) if unicodedata.category(x) == unicodedata.category(c) and _lower(x) == x)


def _lower(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def _digest(key: bytes, *parts: object) -> int:
    said = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(said, key=key[:64], digest_size=64).digest(), "big")


def _shuffle(key: bytes, tweak: str, n: int, x: int, back: bool = False) -> int:
    """Keyed permutation of 0 to n - 1: rounds of adding digests of one half to the other."""
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        low, high = x % a, x // a
        for i in reversed(range(8)) if back else range(8):
            sign = -1 if back else 1
            if i % 2:
                high = (high + sign * _wide(key, b, tweak, n, i, low)) % b
            else:
                low = (low + sign * _wide(key, a, tweak, n, i, high)) % a
        x = low + a * high
        if x < n:
            return x


def _wide(key: bytes, bound: int, *parts: object) -> int:
    """A digest well above the bound, so that its remainder is even."""
    out, i = 0, 0
    while out.bit_length() <= bound.bit_length() + 64 and i * 512 <= bound.bit_length() + 512:
        out, i = out << 512 | _digest(key, *parts, i), i + 1
    return out


def _next(key: bytes, tweak: str, n: int, x: int) -> int:
    """What follows x on a keyed cycle through 0 to n - 1."""
    return _shuffle(key, tweak, n, (_shuffle(key, tweak, n, x) + 1) % n, back=True)


def permuted(key: bytes, tweak: str, text: str, alphabets: list[str], inside: Callable[[str], bool] = lambda _: True) -> str:
    """Image of text, which is inside, under a keyed one-cycle permutation of the strings over alphabets (one a character).

    Only strings that are inside count. A text that is alone inside stays as it is. A text above CHUNK characters, which no
    class bounds, goes chunk by chunk, each under a permutation that hangs on all before it.
    """
    if len(text) > CHUNK:
        short, said, out = hashlib.blake2b(tweak.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), hashlib.blake2b(digest_size=16), []
        for a in range(0, len(text), CHUNK):
            part = text[a : a + CHUNK]
            out.append(permuted(key, f"{short}/{a}/{said.hexdigest()}", part, alphabets[a : a + CHUNK]))
            said.update(part.encode("utf-8", "surrogatepass"))
        return "".join(out)
    n, x = 1, 0
    for c, own in zip(text, alphabets, strict=True):
        n, x = n * len(own), x * len(own) + own.index(c)
    if n == 1:
        return text
    while True:
        x = _next(key, tweak, n, x)
        rest, out = x, []
        for own in reversed(alphabets):
            rest, i = divmod(rest, len(own))
            out.append(own[i])
        image = "".join(reversed(out))
        if image == text or inside(image):
            return image


def _letters(key: bytes, tweak: str, low: str, inside: Callable[[str], bool] = lambda _: True, classes: tuple[str, ...] = ()) -> str:
    """Letters stay in their script (or in the given classes), digits stay digits, all else stays."""
    alphabets = [next((s for s in classes if c in s), None) or alphabet(c) for c in low]
    return permuted(key, f"{tweak}/{''.join(a[0] for a in alphabets)}", low, alphabets, inside)


def _number(key: bytes, tweak: str, digits: str, inside: Callable[[str], bool] = lambda _: True) -> str:
    """As many digits; the first stays 0 or stays above."""
    alphabets = ["0" if digits[0] == "0" else "123456789", *[_DIGITS] * (len(digits) - 1)]
    return permuted(key, f"{tweak}/{len(digits)}/{digits[0] == '0'}", digits, alphabets, inside)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _is_hex(text: str) -> bool:
    return bool(re.fullmatch("[0-9a-f]{8,128}|[0-9A-F]{8,128}", text)) and not text.isdigit() and not text.isalpha()


def canonical(kind: str, text: str) -> tuple[str, str]:
    """Class and canonical form of an entity: its spellings (case, gaps, country code) have one in common."""
    if kind == "email":
        return "email", _lower(text)
    if kind in ("card", "digits"):
        return "card", _only_digits(text)
    if kind == "phone":
        digits = _only_digits(text)
        if text[0] == "+":
            country = re.match(r"\+(1|7|[0-9]{2,3}?(?=\D)|[0-9]{2})", text)[1]
            return "phone", f"{country}:{digits[len(country) :]}"
        return "phone", f"1:{digits[len(digits) == 11 :]}"
    if kind == "iban":
        return "iban", text.replace(" ", "")
    if kind == "hex" or kind == "secret" and _is_hex(text):
        return "hex", text.lower()
    if kind == "ssn":
        return "ssn", _only_digits(text)
    if kind in ("given", "surname"):
        low = _lower(text)
        return ("given" if low in _LISTED else "name"), low
    return kind, text


def _email(key: bytes, tweak: str, low: str) -> str:
    local, _, domain = low.rpartition("@")
    site, _, top = domain.rpartition(".")
    return f"{_letters(key, f'local{tweak}/{domain}', local)}@{_letters(key, f'site{tweak}/{top}', site)}.{top}"


def _phone(key: bytes, tweak: str, low: str) -> str:
    country, _, own = low.partition(":")
    return f"{country}:{_number(key, f'phone{tweak}/{country}', own)}"


def _card(key: bytes, tweak: str, digits: str) -> str:
    if len(digits) < 13 or not luhn(digits):
        return _number(key, f"number{tweak}", digits, lambda x: len(x) < 13 or not luhn(x))
    body = _number(key, f"card{tweak}", digits[:-1])
    return body + next(d for d in _DIGITS if luhn(body + d))


def _ip(key: bytes, tweak: str, text: str) -> str:
    x = int.from_bytes(bytes(map(int, text.split("."))), "big")
    return ".".join(map(str, _next(key, f"ip{tweak}", 1 << 32, x).to_bytes(4, "big")))


def _iban(key: bytes, tweak: str, text: str) -> str:
    body = permuted(key, f"iban{tweak}/{text[:2]}/{''.join('9' if c in _DIGITS else 'A' for c in text[4:])}", text[4:], [_DIGITS if c in _DIGITS else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text[4:]])
    return f"{text[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + text[:2] + '00')) % 97:02d}{body}"


def _hex(key: bytes, tweak: str, low: str) -> str:
    return permuted(key, f"hex{tweak}/{len(low)}", low, ["0123456789abcdef"] * len(low), lambda x: not x.isdigit() and not x.isalpha())


def _secret(key: bytes, tweak: str, text: str) -> str:
    head = next((p for p in ("AKIA", "ghp_", "sk-") if text.startswith(p)), "")
    body = text[len(head) :] or text
    kinds = [next((k for k in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in k), None) or (alphabet(c) if c == _lower(c) else c) for c in body]
    return text[: len(text) - len(body)] + permuted(key, f"secret{tweak}/{head}/{''.join(k[0] for k in kinds)}", body, kinds)


def _given(key: bytes, tweak: str, low: str) -> str:
    names = GIVEN[_LISTED[low]]
    return names[_next(key, f"given{tweak}/{_LISTED[low]}", len(names), names.index(low.capitalize()))].lower()


def _name(key: bytes, tweak: str, low: str) -> str:
    return _letters(key, f"name{tweak}", low, lambda x: x not in _LISTED, (_VOWELS, _CONSONANTS))


_MAKERS: dict[str, Callable[[bytes, str, str], str]] = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "iban": _iban, "hex": _hex, "secret": _secret, "given": _given, "name": _name, "ssn": lambda key, tweak, digits: _number(key, f"ssn{tweak}", digits)}


@lru_cache(maxsize=1 << 13)
def image(key: bytes, group: str, form: str, attempt: int = 0) -> str:
    """Canonical form of the surrogate of a canonical form; each attempt is a permutation of its own."""
    return _MAKERS[group](key, f"#{attempt}" if attempt else "", form)


def _fill(shape: str, wanted: str, new: str) -> str:
    """shape with its characters that wanted holds replaced by new, in order."""
    rest = iter(new)
    return "".join(next(rest) if c in wanted else c for c in shape)


def _dressed(kind: str, text: str, group: str, form: str, new: str) -> str:
    """The canonical surrogate in the spelling of the text."""
    if group in ("email", "name"):
        return "".join(n.upper() if c != c.lower() and len(n.upper()) == 1 else n for c, n in zip(text, new, strict=True))
    if group == "given":
        return new.upper() if text.isupper() else new.capitalize()
    if group in ("card", "ssn"):
        return _fill(text, _DIGITS, new)
    if group == "phone":
        digits, own = _only_digits(text), new.partition(":")[2]
        return _fill(text, _DIGITS, digits[: len(digits) - len(own)] + own)
    if group == "iban":
        return _fill(text, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", new)
    if group == "hex":
        return new.upper() if text == text.upper() else new
    return new


def surrogate(key: bytes, kind: str, text: str, attempt: int = 0) -> str:
    """The surrogate of one entity; needs nothing but the key and, where the corpus has a collision, the attempt."""
    group, form = canonical(kind, text)
    return _dressed(kind, text, group, form, image(key, group, form, attempt))


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    """Mail addresses, each sign looked at from the one before it on, so that no text takes more than linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        done = at + 1
        if start < at and text[at - 1] != "." and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", done)


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _NUMBER.finditer(text):
        kind = "card" if m.lastgroup == "gap" else m.lastgroup
        if kind != "digits" or luhn(m[kind]):
            yield *m.span(kind), kind


def _names(text: str) -> Iterator[tuple[int, int, str]]:
    """Names behind titles or listed given names, and every later or earlier mention of their parts."""
    known: dict[str, str] = {}
    for m in _TITLED.finditer(text) if any(t in text for t in TITLES) else ():
        known |= dict.fromkeys(_PARTS.findall(m["b"] or m["a"]), "surname")
        if m["b"]:
            known = dict.fromkeys(_PARTS.findall(m["a"]), "given") | known
    for m in _UNTITLED.finditer(text) if any(n in text for names in GIVEN.values() for n in names) else ():
        known = {m["a"]: "given"} | dict.fromkeys(_PARTS.findall(m["b"]), "surname") | known
    if known:
        yield from ((m.start(), m.end(), known[m[0]]) for m in _WORD.finditer(text) if m[0] in known and m[0] not in TITLES)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, none over another; the earlier kind wins."""
    low = text.lower().replace("ſ", "s")  # as the pattern ignores case
    kinds = [_emails(text)] if "@" in text else []
    if any(w in low for w in _SECRET_WORDS):
        kinds.append((*m.span(k), "secret") for m in _SECRET.finditer(text) for k in ("value", "known") if m[k] and any(c.isalnum() for c in m[k]))
    if _ANY_DIGITS.search(text):
        kinds.append(_numbers(text))
    kinds.append(_names(text))
    out: list[tuple[int, int, str]] = []
    for found in kinds:  # each in order and without overlaps, as out is
        i, new = 0, []
        for start, end, kind in found:
            while i < len(out) and out[i][1] <= start:
                i += 1
            if i == len(out) or end <= out[i][0]:
                new.append((start, end, kind))
        out = sorted(out + new) if new else out
    return out


_ANY_DIGITS = re.compile(r"[0-9](?:[0-9 ().-]|[A-Fa-f]){5}")


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and where these stand in it: (start, end, kind). attempts: those of the exceptions()."""
    parts, spans, at, size = [], [], 0, 0
    for start, end, kind in find(text):
        attempt = attempts.get(canonical(kind, text[start:end]), 0) if attempts else 0
        own = surrogate(key, kind, text[start:end], attempt)
        parts += [text[at:start], own]
        size += start - at
        spans.append((size, size + len(own), kind))
        size, at = size + len(own), end
    return "".join([*parts, text[at:]]), spans


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """k1, k2 (row key), kind (class), form: the distinct entities of each text, in canonical form."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("kind", pa.string()), ("form", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k1, k2, *own) for k1, k2, t in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), strict=True) if t.is_valid for own in {canonical(k, t.as_py()[a:b]) for a, b, k in find(t.as_py())}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(*row_key("doc_id", text), F.col(text).cast("string").alias("text")).transform(in_batches, run, "k1 long, k2 long, kind string, form string")


def images(forms: DataFrame, key: bytes, attempt: int = 0) -> DataFrame:
    """kind, form, image of every canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [image(key, k, f, attempt) for k, f in zip(batch.column("kind").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("form"), pa.array(own, pa.string())], ["kind", "form", "image"])

    return forms.select("kind", "form").transform(in_batches, run, "kind string, form string, image string")


def exceptions(found: DataFrame, key: bytes) -> DataFrame:
    """kind, form, attempt (above 0) of the entities of mentions() whose first surrogate is itself a real entity.

    A later attempt counts if it equals no real entity, no first surrogate and no other entity's later one; so surrogates
    stay distinct. After ROUNDS attempts an entity keeps its first surrogate, as do listed given names, whose surrogates
    are listed names again.
    """
    real = written(found.select("kind", "form").where("kind <> 'given'").distinct(), "entities", narrow=True)
    first = written(images(real, key), "images", narrow=True)
    taken = real.unionByName(first.select("kind", F.col("image").alias("form")))
    named = real.select("kind", F.col("form").alias("image"))
    twice = Window.partitionBy("kind", "image").orderBy("form")
    left = first.join(named, ["kind", "image"], "left_semi").unionByName(first.withColumn("n", F.row_number().over(twice)).where("n > 1").drop("n")).select("kind", "form").distinct()
    left = written(left, "colliding", narrow=True)
    done = left.select("*", F.lit(0).alias("attempt")).limit(0)
    for attempt in range(1, ROUNDS + 1):
        if not left.limit(1).count():
            break
        tried = images(left, key, attempt).join(taken.withColumnRenamed("form", "image").distinct(), ["kind", "image"], "left_anti")
        free = written(tried.withColumn("n", F.row_number().over(twice)).where("n = 1").drop("n"), "free", narrow=True)
        done = done.unionByName(free.select("kind", "form", F.lit(attempt).alias("attempt")))
        taken = taken.unionByName(free.select("kind", F.col("image").alias("form")))
        left = written(left.join(free, ["kind", "form"], "left_anti"), "colliding", narrow=True)
    return done


def replaced(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """row (a struct of docs' columns), text (with surrogates), n_replaced and spans ("kind:start+length;...") of every row.

    Texts are read twice: for the entities of the corpus, whose collisions are resolved first, and to replace them. Null
    texts stay null with 0 replaced; empty texts and texts without entities stay; repeated rows fare alike.
    """
    key = _checked(key)
    found = written(mentions(docs, text), "mentions")
    own = found.join(exceptions(found, key), ["kind", "form"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "form", "attempt")).alias("fixes"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"), *row_key("doc_id", text))
    rows = rows.join(written(own, "fixes", narrow=True), ["k1", "k2"], "left").select("row", "text", "fixes")
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for t, fixes in zip(batch.column("text"), batch.column("fixes"), strict=True):
                attempts = {(f["kind"], f["form"]): f["attempt"] for f in fixes.as_py()} if fixes.is_valid else None
                got.append(replace(t.as_py(), key, attempts) if t.is_valid else (None, []))
            spans = [";".join(f"{k}:{a}+{b - a}" for a, b, k in s) for _, s in got]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([t for t, _ in got], pa.string()), pa.array([len(s) for _, s in got], pa.int64()), pa.array(spans, pa.string())], ["row", "text", "n_replaced", "spans"])

    return rows.transform(in_batches, run, f"row {kind}, text string, n_replaced long, spans string")


def with_surrogates(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with each text's entities replaced by surrogates; all columns and rows stay, null texts stay null.

    The key has LEAST_KEY bytes or more and is secret: whoever has it can undo the surrogates.
    """
    out = replaced(docs, key, text)
    return out.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, kind, entity, surrogate (the first attempt's), start, length of every entity (start in the text as it was)."""
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, kind, t[a:b], surrogate(key, kind, t[a:b]), a, b - a) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for a, b, kind in find(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_batches, run, "doc_id long, kind string, entity string, surrogate string, start long, length long")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, number replaced, and their kinds and places, of every document.

    Null texts stay null; empty texts stay empty; repeated rows give repeated, equal rows.
    """
    out = replaced(load(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    return out.select("row.doc_id", "text", "n_replaced", "spans")
