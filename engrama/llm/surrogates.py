"""Personal data replaced by keyed surrogates of the same type and shape.

Detected: e-mail addresses, phone numbers, IP addresses, card and account
numbers, national numbers of the shape 3-2-4, IBANs, and names after a form of
address, with all further mentions of those names in the text. A surrogate keeps what a reader can see of the type: separators,
letter case and script, the gender that the form of address tells, a valid
check digit where there was one.

Numbers go through a keyed permutation of the digit strings of their length, so
distinct numbers of a format stay distinct; letters likewise. Names are drawn
by key. Over all entities of the corpus it is then checked that no two share a
surrogate and that no surrogate is itself an entity; a given name is one entity,
whose gender is the one that most of its mentions tell; in capitals it is the
same entity. Those that fail try again with the next tweak until none is left.
Surrogates of addresses and names grow, so that comes to an end; numbers of one
shape that are still not free after PATIENCE tries all take one permutation, under
which they stay distinct. The same entity gets the same surrogate everywhere.

Texts are read twice and not shuffled; only distinct entities are.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.hashing import thrifty
from engrama.llm.shared import stash

#: Tries of a number, after which all numbers of its kind and shape take one permutation, whatever it gives.
PATIENCE = 50
#: Entities that need a further tweak, up to which they are sent to every task.
EXCEPTIONS = 50_000

EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]*\w@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NUMBER = re.compile(r"(?<![\w.+(-])[+(]?\d[\d ().+-]{5,}\d(?!\w)")
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]{6,39}(?![\w:]))[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
IPV4 = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
NATIONAL = re.compile(r"\d{3}-\d{2}-\d{4}")
ACCOUNT = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}")
PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\+\d{1,3}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){2,3}|\d{3}([ .-])\d{3}\1\d{4}|0\d{2,4}[ -]\d{4,8}")
#: Forms of address and the gender they tell: fixed values.
ADDRESS = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Mister": "m", "Sir": "m", "Madam": "f", "Dr": "", "Prof": "",
    "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĮİĶĹĽŁŃŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽΑ-ΩΆΈΉΊΌΎΏА-ЯЁ"
NAMED = re.compile(rf"(?<!\w)({'|'.join(sorted(ADDRESS, key=len, reverse=True))})\.?((?: [{_UPPER}][\w'’]+(?:-[{_UPPER}][\w'’]+)*){{1,3}})(?!\w)")

#: Abbreviations: after the others a full stop ends a sentence, and what follows need not be a name.
SHORT = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Mme", "Mlle", "Sr", "Sra")
_WORD = re.compile(r"\w+(?:['’-]\w+)*")
_PARTS = tuple(re.compile(x) for x in (r"\w+(?:['’-]\w+)*?(?=['’]s$)", r"\w+(?:['’]\w+)*?(?=['’]s(?!\w)|(?!['’\w]))", r"\w+"))

#: Given names by script and gender: fixed values.
GIVEN = {
    ("latin", "f"): "Ada Alba Anna Bella Carla Clara Dora Edith Ella Elsa Emma Eva Flora Greta Hanna Helena Ida Ines Irma Jana Julia Lara Lena Lina Lisa Lucia Maria Marta Mira Nina Nora Olga Paula Rita Rosa Sara Sofia Tina Vera Zoe",
    ("latin", "m"): "Adam Albert Anton Arno Bruno Carl Conrad David Diego Edgar Emil Erik Felix Franz Georg Gustav Hugo Igor Ivan Jakob Jan Jonas Josef Karl Leo Leon Luca Marco Mario Max Noah Oscar Otto Pablo Paul Peter Robert Simon Tom Victor",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Лариса Мария Нина Ольга Полина Раиса Софья Тамара Юлия",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Фёдор",
    ("greek", "f"): "Άννα Ειρήνη Ελένη Ζωή Μαρία Σοφία Χλόη Δάφνη",
    ("greek", "m"): "Αλέξης Γιάννης Ηλίας Κώστας Λουκάς Νίκος Πέτρος Σπύρος",
}
#: Syllables of made-up family names by script: fixed values.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga ge go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo",
    "cyrillic": "ба бе бо ва ве во га ге го да де до ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то",
    "greek": "βα βε βο γα γε γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το",
}


def _number(key: bytes, *what: object) -> int:
    """A keyed 128-bit number."""
    return int.from_bytes(hashlib.blake2b(repr(what).encode(), key=key, digest_size=16).digest(), "big")


def permuted(key: bytes, values: list[int], radix: int, tweak: str) -> list[int]:
    """A keyed permutation of the digit strings of this length: a Feistel network over two halves."""
    n = len(values)
    if n < 2:
        return [(v + _number(key, tweak, radix)) % radix for v in values]
    half = n // 2
    join = lambda part: sum(v * radix**i for i, v in enumerate(part))
    left, right = join(values[:half]), join(values[half:])
    a, b = radix**half, radix ** (n - half)
    for r in range(8):
        if r % 2 == 0:
            left = (left + _number(key, tweak, n, r, right)) % a
        else:
            right = (right + _number(key, tweak, n, r, left)) % b
    return [left // radix**i % radix for i in range(half)] + [right // radix**i % radix for i in range(n - half)]


def _with_digits(entity: str, digits: list[int]) -> str:
    new = iter(digits)
    return "".join(str(next(new)) if c.isdecimal() else c for c in entity)


def _digits(entity: str) -> list[int]:
    return [int(c) for c in entity if c.isdecimal()]


def luhn(digits: list[int]) -> int:
    """The check digit for these digits."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _account(key: bytes, entity: str, tweak: str) -> str:
    """The first digit stays; the last keeps its difference to the check digit."""
    d = _digits(entity)
    body = [d[0], *permuted(key, d[1:-1], 10, tweak)]
    return _with_digits(entity, [*body, (luhn(body) + d[-1] - luhn(d[:-1])) % 10])


def _phone(key: bytes, entity: str, tweak: str) -> str:
    """The country code stays."""
    code = re.match(r"\+\d{1,3}(?=[ .(-])", entity)
    kept = code.group() if code else ""
    rest = entity[len(kept) :]
    return kept + _with_digits(rest, permuted(key, _digits(rest), 10, tweak))


def _ipv4(key: bytes, entity: str, tweak: str) -> str:
    octets = [int(x) for x in entity.split(".")]
    return ".".join(map(str, permuted(key, octets, 256, tweak)))


def _ipv6(key: bytes, entity: str, tweak: str) -> str:
    """Groups keep their lengths; capitals stay capitals."""
    new = iter(permuted(key, [int(c, 16) for c in entity if c != ":"], 16, tweak))
    made = "".join(c if c == ":" else f"{next(new):x}" for c in entity)
    return made.upper() if any(c.isupper() for c in entity) else made


#: Letters beyond ASCII that are permuted among their own: fixed values.
LETTERS = ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ")


def _foreign(key: bytes, word: str, tweak: str) -> str:
    """Letters beyond ASCII permuted within their script, case kept; those of other scripts become Latin by key."""
    new = list(word)
    for letters in LETTERS:
        own = [i for i, c in enumerate(word) if not c.isascii() and c.lower() in letters]
        for i, v in zip(own, permuted(key, [letters.index(word[i].lower()) for i in own], len(letters), tweak), strict=True):
            new[i] = letters[v].upper() if word[i].isupper() else letters[v]
    for i, c in enumerate(word):
        if not c.isascii() and c.isalpha() and not any(c.lower() in letters for letters in LETTERS):
            new[i] = chr(97 + _number(key, "other", word, i, tweak) % 26)
    return "".join(new)


def _letters(key: bytes, word: str, tweak: str) -> str:
    """ASCII letters and digits permuted within their kind; case and all else stay."""
    low = [i for i, c in enumerate(word) if c.isascii() and c.isalpha()]
    new = list(_with_digits(word, permuted(key, _digits(word), 10, tweak)) if any(c.isdecimal() for c in word) else word)
    for i, v in zip(low, permuted(key, [ord(word[i].lower()) - 97 for i in low], 26, tweak), strict=True):
        new[i] = chr(v + (65 if word[i].isupper() else 97))
    return "".join(new)


def _email(key: bytes, entity: str, tweak: str) -> str:
    """Both sides but the top domain and an ``example`` one; from the third tweak on the user's part grows, so that some surrogate is free."""
    user, _, domain = entity.partition("@")
    *parts, top = domain.split(".")
    longer = "".join(chr(97 + _number(key, "longer", entity, tweak, i) % 26) for i in range(int(tweak) - 2))
    return f"{_letters(key, _foreign(key, user, tweak + 'u'), tweak + 'u')}{longer}@{'.'.join(p if p.lower() == 'example' else _letters(key, p, tweak + str(i)) for i, p in enumerate(parts))}.{top}"


def _iban(key: bytes, entity: str, tweak: str) -> str:
    """The country stays; the check digits are made anew."""
    flat = entity.replace(" ", "")
    body = _letters(key, flat[4:], tweak)
    check = 98 - int("".join(str(int(c, 36)) for c in body + flat[:2] + "00")) % 97
    new = iter(f"{flat[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(new) for c in entity)


def script_of(name: str) -> str:
    c = name[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _given(gender: str) -> Callable[[bytes, str, str], str]:
    def draw(key: bytes, entity: str, tweak: str) -> str:
        """Of the same gender and script; later tweaks add a second name."""
        pool = GIVEN[script_of(entity), gender or "fm"[_number(key, "gender", entity) % 2]].split()
        first = pool[_number(key, "given", entity, tweak) % len(pool)]
        return first if tweak == "0" else f"{first}-{pool[_number(key, 'second', entity, tweak) % len(pool)]}" + _family(key, entity, tweak).lower() * (int(tweak) > 3)

    return draw


def _family(key: bytes, entity: str, tweak: str) -> str:
    parts = SYLLABLES[script_of(entity)].split()
    x, out = _number(key, "family", entity, tweak), ""
    for _ in range(4 + int(tweak)):
        x, at = divmod(x, len(parts))
        out += parts[at]
    return out.capitalize()


MAKERS: dict[str, Callable[[bytes, str, str], str]] = {"email": _email, "iban": _iban, "ipv4": _ipv4, "ipv6": _ipv6, "national": _phone, "account": _account, "phone": _phone, "given": _given(""), "given_f": _given("f"), "given_m": _given("m"), "family": _family}


#: Kinds whose makers permute what has one shape.
PERMUTED = ("iban", "ipv4", "ipv6", "national", "account", "phone")


def spelled(name: str) -> str:
    """A name in capitals as it is otherwise spelled; others as they are."""
    return re.sub(r"\w+", lambda m: m.group()[0] + m.group()[1:].lower(), name) if len(name) > 1 and name.isupper() else name


def entity_of(kind: str, text: str) -> str:
    """What a mention stands for."""
    return spelled(text) if kind == "family" or kind.startswith("given") else text


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    return MAKERS[kind](key, entity, str(attempt))


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data of a text, in order, without overlaps."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    free = lambda a, b: all(b <= x or y <= a for x, y, _ in found)
    if "@" in text:
        found += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if text.count(":") > 1:
        found += [(*m.span(), "ipv6") for m in IPV6.finditer(text) if _valid_ipv6(m.group())]
    for m in IBAN.finditer(text):
        if _valid_iban(m.group().replace(" ", "")) and free(*m.span()):
            found.append((*m.span(), "iban"))
    for m in NUMBER.finditer(text):
        for part in _numbers(m.group()):
            a, b = m.start() + part[0], m.start() + part[1]
            if free(a, b):
                found.append((a, b, part[2]))
    if any(word in text for word in ADDRESS):
        known: dict[str, str] = {}
        for m in NAMED.finditer(text):
            at, names = m.start(2), m.group(2).split(" ")[1:]
            for i, name in enumerate(names):
                a = at + 1
                at = a + len(name)
                end = at - 2 if name.endswith(("'s", "’s")) else at
                kind = "family" if i == len(names) - 1 else "given" + (ADDRESS[m[1]] and "_" + ADDRESS[m[1]])
                if free(a, end):
                    found.append((a, end, kind))
                if m[1] in SHORT or text[m.end(1)] != ".":
                    # of a name in both places, the family's stands alone
                    name = spelled(text[a:end])
                    known[name] = "family" if known.get(name) == "family" else kind
        if known:
            taken = bytearray(len(text))
            for a, b, _ in found:
                taken[a:b] = b"\1" * (b - a)
            for m in _WORD.finditer(text):
                # a compound as a whole, or else its parts
                for a, b in [m.span()] if spelled(m.group()) in known else _known_parts(known, m.group(), m.start()):
                    if not any(taken[a:b]):
                        found.append((a, b, known[spelled(text[a:b])]))
    return sorted(found)


def _known_parts(known: dict[str, str], word: str, at: int) -> list[tuple[int, int]]:
    """Where known names stand in a word of several parts: without its ending, between hyphens, or between all signs."""
    for pattern in _PARTS if not word.isalnum() else ():
        hit = [(at + m.start(), at + m.end()) for m in pattern.finditer(word) if spelled(m.group()) in known]
        if hit:
            return hit
    return []


def _valid_ipv6(address: str) -> bool:
    """Of three groups or more: shorter ones are found in source code."""
    if sum(map(bool, address.split(":"))) < 3:
        return False
    try:
        return ipaddress.IPv6Address(address) is not None
    except ValueError:
        return False


def _valid_iban(flat: str) -> bool:
    return sum(c.isdigit() for c in flat) >= 8 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _numbers(run: str) -> list[tuple[int, int, str]]:
    """What a run of digits and separators holds; several numbers may stand side by side."""
    found: list[tuple[int, int, str]] = []
    for kind, pattern in (("ipv4", IPV4), ("national", NATIONAL), ("account", ACCOUNT), ("phone", PHONE)):
        for m in pattern.finditer(run):
            a, b = m.span()
            if kind == "ipv4" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if _alone(run, a, b) and all(b <= x or y <= a for x, y, _ in found):
                found.append((a, b, kind))
    return found


def _alone(run: str, a: int, b: int) -> bool:
    return not (run[a - 1 : a].isdigit() or run[b : b + 1].isdigit() or re.match(r"\.\d", run[b:]) or re.search(r"\d\.$", run[:a]))


def replaced(key: bytes, text: str | None, attempts: dict, genders: dict | None = None) -> tuple[str | None, int]:
    """The text with its entities replaced, and how many there are; ``genders`` has another kind for some (kind, given name)."""
    genders = genders or {}
    found = entities(text)
    out, at = [], 0
    for a, b, kind in found:
        entity = entity_of(kind, text[a:b])
        kind = genders.get((kind, entity), kind)
        made = surrogate(key, kind, entity, attempts.get((kind, entity), 0))
        out += [text[at:a], made if entity == text[a:b] else made.upper()]
        at = b
    return (text if not found else "".join(out) + text[at:]), len(found)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter((kind, entity_of(kind, text[a:b])) for text in batch.column(0).to_pylist() for a, b, kind in entities(text))
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in seen], pa.string()), "entity": pa.array([e for _, e in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def mentioned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``kind``, ``entity``, and the kind that counts (``resolved``): a given name has the gender that most mentions tell, none if as many tell the other."""
    found = stash(docs.select(docs[text].alias("text")).mapInArrow(thrifty(_counted), "kind string, entity string, n long").groupBy("kind", "entity").agg(F.sum("n").alias("n")))
    told = F.sum(F.when(F.col("kind") == "given_f", F.col("n")).when(F.col("kind") == "given_m", -F.col("n")).otherwise(0)).alias("told")
    names = found.filter(F.col("kind").startswith("given"))
    gender = names.groupBy("entity").agg(told).select("entity", F.when(F.col("told") > 0, "given_f").when(F.col("told") < 0, "given_m").otherwise("given").alias("resolved"))
    return stash(names.join(gender, "entity").select("kind", "entity", "resolved").union(found.filter(~F.col("kind").startswith("given")).select("kind", "entity", F.col("kind").alias("resolved"))))


def exceptions(docs: DataFrame, key: bytes, text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """``kind``, ``entity``, ``attempt`` (from 1) of the entities whose first surrogate is not free."""

    @F.arrow_udf("string")
    def made(kinds: pa.Array, names: pa.Array, attempts: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, *row) for row in zip(kinds.to_pylist(), names.to_pylist(), attempts.to_pylist(), strict=True)], pa.string())

    found = mentioned(docs, text) if found is None else found
    known = stash(found.select(F.col("resolved").alias("kind"), "entity").distinct())
    group = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    tried, tries = known.withColumn("attempt", F.lit(0)), 0
    while True:
        now = stash(tried.withColumn("made", made("kind", "entity", "attempt")))
        # of those that share a surrogate the one tried most, then the first, keeps it
        keeper = now.groupBy(group.alias("g"), "made").agg(F.max_by(F.struct("kind", "entity"), F.struct("attempt", F.hash("kind", "entity"), "kind", "entity")).alias("own"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        lost = now.join(keeper, (group == F.col("g")) & (now["made"] == keeper["made"])).filter((F.col("own.kind") != F.col("kind")) | (F.col("own.entity") != F.col("entity"))).select("kind", "entity")
        real = now.join(known.select(F.col("kind").alias("__k"), F.col("entity").alias("__real")), (F.col("kind") == F.col("__k")) & (F.col("made") == F.col("__real"))).select("kind", "entity")
        settled = F.col("kind").isin(*PERMUTED) & (F.col("attempt") >= PATIENCE)
        again = stash(lost.union(real).distinct().join(now.filter(settled).select("kind", "entity"), ["kind", "entity"], "left_anti").withColumn("more", F.lit(1)))
        if again.isEmpty():
            return now.filter("attempt > 0").select("kind", "entity", "attempt")
        tried = now.join(again, ["kind", "entity"], "left").select("kind", "entity", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))
        tries += 1
        if tries >= PATIENCE:
            form = F.regexp_replace(F.regexp_replace("entity", r"\p{L}", "a"), r"\d", "0").alias("form")
            stuck = tried.filter(settled).select("kind", form).distinct().withColumn("__at", F.lit(PATIENCE))
            tried = tried.select("*", form).join(stuck, ["kind", "form"], "left").select("kind", "entity", F.coalesce("__at", "attempt").alias("attempt"))


def _tables(rest: Iterable) -> tuple[dict, dict]:
    """Attempts by the kind that counts and entity, and that kind by the mention's own and entity."""
    return {(r["resolved"], r["entity"]): r["attempt"] for r in rest}, {(r["kind"], r["entity"]): r["resolved"] for r in rest}


def _unused(columns: list[str], name: str) -> str:
    """A column name that the table doesn't have, whatever the case."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", counted: str = "n_entities") -> DataFrame:
    """``docs`` with the text replaced and the number of entities in ``counted``.

    A null text stays null and has none; very long texts are replaced whole.
    Rows, repeated ones too, and other columns stay as they are. A column that
    is already called ``counted`` is replaced. An empty table gives no rows.
    """
    found = mentioned(docs, text)
    tried = exceptions(docs, key, text, found).withColumnRenamed("kind", "resolved")
    rest = stash(found.join(tried, ["resolved", "entity"], "left").filter("attempt is not null or kind <> resolved").select("kind", "entity", "resolved", F.coalesce("attempt", F.lit(0)).alias("attempt")))
    few = rest.limit(EXCEPTIONS + 1).count() <= EXCEPTIONS
    kind, made = "struct<text:string,n:bigint>", _unused(docs.columns, "made")
    fields = pa.struct([("text", pa.string()), ("n", pa.int64())])
    listed = lambda rows: pa.array([{"text": t, "n": n} for t, n in rows], fields)
    if few:
        attempts, genders = _tables(rest.collect())

        @F.arrow_udf(kind)
        def apply(texts: pa.Array) -> pa.Array:
            return listed(replaced(key, t, attempts, genders) for t in texts.to_pylist())

        out = docs.withColumn(made, apply(docs[text]))
    else:  # by the text: its own exceptions only
        digest = lambda c: F.unhex(F.md5(F.coalesce(c, F.lit(""))))

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, k, entity_of(k, t[a:b])) for d, t in zip(*[c.to_pylist() for c in batch.columns], strict=True) for a, b, k in entities(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.string(), pa.string()))], names=["digest", "kind", "entity"])

        place, lists = _unused(docs.columns, "digest"), _unused(docs.columns, "own")
        own = docs.select(digest(docs[text]).alias("digest"), docs[text].alias("text")).mapInArrow(thrifty(met), "digest binary, kind string, entity string").distinct().join(rest, ["kind", "entity"])
        own = own.groupBy(F.col("digest").alias(place)).agg(F.collect_list(F.struct("kind", "entity", "resolved", "attempt")).alias(lists))

        @F.arrow_udf(kind)
        def apply_own(texts: pa.Array, exceptions: pa.Array) -> pa.Array:
            return listed(replaced(key, t, *_tables(x or ())) for t, x in zip(texts.to_pylist(), exceptions.to_pylist(), strict=True))

        with_place = docs.withColumn(place, digest(docs[text]))
        out = with_place.join(own, place, "left").withColumn(made, apply_own(with_place[text], own[lists]))
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return out.select(*[F.col(f"{made}.text").alias(text) if c == text else quoted(c) for c in docs.columns if c != counted], F.col(f"{made}.n").alias(counted))
