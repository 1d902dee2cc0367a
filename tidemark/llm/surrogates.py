"""Surrogate generation for personal data.

Entities (mail addresses, phone numbers, IPv4 and IPv6 addresses, card numbers, bank accounts, social security
numbers, secret tokens and keys, names of persons) are replaced by surrogates of the same kind, drawn by a keyed hash of the entity's canonical
form: one person's number has one surrogate wherever and however it is written. A surrogate keeps the format it
stands in (punctuation, digits, case, hexadecimal, checksums of cards and bank accounts, prefixes of keys); names
keep gender and script, and first and last names are drawn one by one. A part of a name found once in a text is that
name wherever else it stands there as a capitalised word, so that a full name and a surname or given name alone agree.
A phone number's country code is part of it, and stays; without one it is a number of ``HOME_CODE``.

Distinct entities get distinct surrogates, and no surrogate is an entity of the corpus: all distinct entities
are drawn, draws that meet another or a real entity are drawn again (the smallest canonical form keeps its
draw), until none is left. Names are one kind in this, whatever their gender or script. Few draws meet, so few are drawn again; those are sent along with the function while
there are at most ``MAX_OVERRIDES``, and joined by document beyond.

A null text stays null and has no entities. A null doc_id is carried. Repeated rows get equal results. Empty
table: empty result. Extra columns are unread. Texts are whole.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable

MAX_OVERRIDES = 200_000
HOME_CODE = "1"  # country code of phone numbers that are written without one
DEMO_KEY = b"tidemark demonstration key"  # callers pass a secret of their own

# Given names by gender and script, and titles with the gender they tell.
GIVEN = {
    ("f", "latin"): "Anna Maria Emma Sophie Laura Julia Lena Marie Claire Camille Elena Lucia Carmen Sofia Isabel Mary Linda Susan Karen Sarah Emily Olivia Alice Jane Elizabeth".split(),
    ("m", "latin"): "Peter Paul Hans Lukas Jonas Thomas Michael David James John Robert William Richard Daniel Pierre Jean Louis Antoine Carlos Juan Miguel Jose Pedro Luis George".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Dr": "x", "Prof": "x"}
# Parts that surrogate names are built from, by script, and endings by gender.
PARTS = {
    "latin": "ba be bo da de do fa fe fi ga go ha ka ke ki la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе бо ва ве ви га да де до ка ке ки ла ле ли ма ме ми на не ни ра ре ри са се си та те ти".split(),
}
ENDINGS = {
    ("f", "latin"): ["na", "la", "ra", "sa"],
    ("m", "latin"): ["n", "rt", "s", "l"],
    ("f", "cyrillic"): ["на", "ла", "ра", "ся"],
    ("m", "cyrillic"): ["н", "р", "с", "л"],
    ("x", "latin"): ["man", "ner", "ley", "ton"],
    ("x", "cyrillic"): ["енко", "ин", "ов", "ский"],
}

_GENDER = {name: key for key, names in GIVEN.items() for name in names}
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+"
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_NUMBER = re.compile(
    r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w))"
    r"|(?P<token>(?<![0-9A-Za-z])(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))"
)
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_IBAN = re.compile(r"[A-Z](?<![0-9A-Za-z].)[A-Z]\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
_KEY = re.compile(r"(?<![0-9A-Za-z_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z_])")
KEY_PREFIXES = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
_DIGITS = re.compile(r"\d\d")
_NAMES = re.compile(rf"{_NAME}(?:\.? {_NAME})+")
_LETTERS = re.compile(r"[^\W\d_]+")


def _persons(text: str) -> Iterator[tuple[int, int, str, str]]:
    """The parts of names that follow a title, or are a given name and the word after it."""
    for m in _NAMES.finditer(text):
        words = [(w.start() + m.start(), w[0]) for w in _LETTERS.finditer(m[0])]
        k = 0
        while k < len(words):
            told = TITLES.get(words[k][1])
            first = k + 1 if told else k
            known = first < len(words) and words[first][1] in _GENDER
            names = words[first : first + 2] if told or known else []
            if told and not known:
                names = words[first : first + 1]
            if len(names) + bool(told) < 2:
                k += 1
                continue
            for n, (start, name) in enumerate(names):
                script = "cyrillic" if "а" <= name[-1].lower() <= "ё" else "latin"
                gender = _GENDER.get(name, (told or "x", script))[0] if n < len(names) - 1 else "x"
                yield start, start + len(name), f"name-{gender}-{script}", name.lower()
            k = first + len(names)


def _mentions(text: str) -> Iterator[tuple[int, int, str, str]]:
    """All places of the names that a text tells: where they are told, and wherever else they stand capitalised."""
    told = list(_persons(text))
    kinds: dict[str, str] = {}
    for _, _, kind, name in told:
        kinds.setdefault(name, kind)
    yield from told
    if kinds:
        known = {start for start, *_ in told}
        for m in _LETTERS.finditer(text):
            if m[0][0].isupper() and m.start() not in known and m[0].lower() in kinds:
                yield m.start(), m.end(), kinds[m[0].lower()], m[0].lower()


def _phone(raw: str) -> str:
    """National digits, after the country code and a hyphen if that is not ``HOME_CODE``."""
    code = re.match(r"\+(\d{1,3})(?!\d)", raw)
    digits = re.sub(r"\D", "", raw)
    if code is None:
        return digits
    national = digits[len(code[1]) :]
    return national if code[1] == HOME_CODE else f"{code[1]}-{national}"


def iban_check(country: str, account: str) -> str:
    """The two check digits of a bank account."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _checked(text: str) -> Iterator[tuple[int, int, str, str]]:
    """IPv6 addresses, bank accounts and keys."""
    if _COLONS.search(text):
        for m in _IPV6.finditer(text):
            if sum(map(bool, m[0].split(":"))) > 2 and any(map(str.isdigit, m[0])):
                try:
                    yield m.start(), m.end(), "ipv6", ipaddress.IPv6Address(m[0]).exploded
                except ValueError:
                    continue  # a time or a row of numbers
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if iban_check(plain[:2], plain[4:]) == plain[2:4]:
            yield m.start(), m.end(), "iban", plain
    if any(prefix in text for prefix in KEY_PREFIXES):
        for m in _KEY.finditer(text):
            yield m.start(), m.end(), "key", m[0]


def entities_of(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity; a person is one entity for each part of the name.

    Of entities that overlap, the one that starts first counts; mail addresses go before all others.
    """
    text = text or ""
    found = [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)] if "@" in text else []
    if _DIGITS.search(text) or "." in text and re.search(r"\d\.\d", text):
        for m in _NUMBER.finditer(text):
            raw, digits = m[0], re.sub(r"\D", "", m[0])
            if m.lastgroup != "ip" or all(int(x) <= 255 for x in raw.split(".")):
                found.append((m.start(), m.end(), m.lastgroup, {"ip": raw, "token": raw.lower(), "phone": _phone(raw)}.get(m.lastgroup, digits)))
    found += _checked(text)
    found += _mentions(text)
    out, end = [], 0
    for e in sorted(found, key=lambda e: (e[0], e[2] != "email")):
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


def _stream(key: bytes, kind: str, value: str, attempt: int) -> Iterator[int]:
    """Bytes of a keyed hash in counter mode."""
    n = 0
    while True:
        yield from hashlib.blake2b(f"{kind}|{attempt}|{n}|{value}".encode("utf-8", "surrogatepass"), key=key[:64]).digest()
        n += 1


def luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def draw(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate's canonical form: of the same kind and size."""
    s = _stream(key, kind, value, attempt)
    digit = lambda: str(next(s) % 250 % 10)
    if kind.startswith("name-"):
        _, gender, script = kind.split("-")
        parts, ends = PARTS[script], ENDINGS[gender, script]
        return "".join(parts[(next(s) << 8 | next(s)) % len(parts)] for _ in range(2 + next(s) % 2 + attempt // 8)) + ends[next(s) % len(ends)]
    alike = lambda c: digit() if c.isdigit() else chr((65 if c.isupper() else 97) + next(s) % 26) if c.isalpha() else c
    if kind == "phone":
        code, hyphen, national = value.rpartition("-")
        return code + hyphen + "".join(map(alike, national))
    if kind == "ipv6":  # groups of zeros stay, so that what is shortened stays short
        return ":".join("0000" if int(g, 16) == 0 else f"{1 + (next(s) << 8 | next(s)) % 65535:04x}" for g in value.split(":"))
    if kind == "iban":
        account = "".join(map(alike, value[4:]))
        return value[:2] + iban_check(value[:2], account) + account
    if kind == "key":
        prefix = next(p for p in KEY_PREFIXES if value.startswith(p))
        return prefix + "".join(map(alike, value[len(prefix) :]))
    if kind == "ip":
        return ".".join(str(next(s) if k else 1 + next(s) % 223) for k in range(4))
    if kind == "email":
        name, _, tail = value.rpartition(".")
        return "".join(digit() if c.isdigit() else chr(97 + next(s) % 26) if c.isalpha() else c for c in name) + "." + tail
    if kind == "token":
        return "".join("0123456789abcdef"[next(s) % 16] for _ in value)
    out = "".join(digit() for _ in value)
    if kind == "card" and luhn(value) == 0:
        out = out[:-1] + str((10 - luhn(out[:-1] + "0")) % 10)
    return out


def render(raw: str, kind: str, surrogate: str) -> str:
    """The surrogate in the format that the entity stands in."""
    if kind == "key":
        return surrogate
    if kind == "ipv6":
        short = ipaddress.IPv6Address(surrogate).compressed if "::" in raw else surrogate
        return short.upper() if any(c in "ABCDEF" for c in raw) else short
    if kind == "iban":
        left = iter(surrogate)
        return "".join(c if c == " " else next(left) for c in raw)
    if kind in ("ssn", "card", "phone"):
        surrogate = surrogate.rpartition("-")[2]
        n = sum(c.isdigit() for c in raw)
        digits, lead = iter(surrogate), n - len(surrogate)  # leading country digits stay
        out = []
        for c in raw:
            if c.isdigit():
                lead -= 1
                c = c if lead >= 0 else next(digits)
            out.append(c)
        return "".join(out)
    if raw.isupper() and len(raw) > 1:
        return surrogate.upper()
    if kind.startswith("name-"):
        return surrogate.capitalize()
    if kind == "email" and len(raw) == len(surrogate):
        return "".join(b.upper() if a.isupper() else b for a, b in zip(raw, surrogate))
    return surrogate


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = sorted({(k, v) for t in batch.column(0).to_pylist() for _, _, k, v in entities_of(t)})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())], ["kind", "value"])


def _drawn(key: bytes, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [draw(key, k, v, attempt) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["kind", "value", "surrogate"])

    return run


def assign(docs: DataFrame, key: bytes, most_rounds: int = 60) -> DataFrame:
    """(kind, value, surrogate, attempt) for all distinct entities: surrogates are distinct and no real entity."""
    real = durable(docs.select("text").mapInArrow(_found, "kind string, value string").distinct(), "entities")
    taken, left = None, real
    family = F.substring_index("kind", "-", 1).alias("family")  # names of all genders and scripts are one
    entities = real.select(family, F.col("value").alias("surrogate"))
    for attempt in range(most_rounds):
        drawn = durable(left.mapInArrow(_drawn(key, attempt), "kind string, value string, surrogate string"), "drawn")
        first = drawn.groupBy(family, "surrogate").agg(F.min(F.struct("value", "kind")).alias("of"))
        ok = first.join(entities, ["family", "surrogate"], "left_anti")
        if taken is not None:
            ok = ok.join(taken.select(family, "surrogate"), ["family", "surrogate"], "left_anti")
        ok = durable(ok.select("of.kind", "of.value", "surrogate", F.lit(attempt).alias("attempt")), "assigned")
        taken = ok if taken is None else taken.unionByName(ok)
        left = durable(drawn.select("kind", "value").join(ok.select("kind", "value"), ["kind", "value"], "left_anti"), "left")
        if left.isEmpty():
            return taken
    raise RuntimeError(f"no distinct surrogates after {most_rounds} rounds")


def replace_entities(docs: DataFrame, key: bytes = DEMO_KEY, max_overrides: int = MAX_OVERRIDES) -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities, kinds (distinct, sorted, comma-joined)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = durable(assign(docs, key).where("attempt > 0").select("kind", "value", "surrogate"), "again")
    few = again.limit(max_overrides + 1).count() <= max_overrides
    overrides = {(r["kind"], r["value"]): r["surrogate"] for r in again.collect()} if few else {}
    if few:
        rows = docs.withColumn("own", F.lit(None).cast("array<struct<kind:string,value:string,surrogate:string>>"))
    else:
        seen = docs.select(F.xxhash64("text").alias("of"), "text").mapInArrow(_occurrences, "of long, kind string, value string")
        per = seen.join(again, ["kind", "value"]).groupBy("of").agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("own"))
        rows = docs.join(per, F.xxhash64("text") == F.col("of"), "left").select("doc_id", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                special = {(o["kind"], o["value"]): o["surrogate"] for o in own or ()} or overrides
                found, pieces, at = entities_of(text), [], 0
                for start, end, kind, value in found:
                    pieces += [text[at:start], render(text[start:end], kind, special.get((kind, value)) or draw(key, kind, value))]
                    at = end
                out[0].append(None if text is None else "".join([*pieces, text[at:]]))
                out[1].append(len(found))
                out[2].append(",".join(sorted({k.split("-")[0] for _, _, k, _ in found})))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                ["doc_id", "text", "n_entities", "kinds"],
            )

    return rows.mapInArrow(run, "doc_id long, text string, n_entities long, kinds string")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = sorted({(i, k, v) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for _, _, k, v in entities_of(t)})
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[n] for g in got], pa.string()) for n in (1, 2))], ["of", "kind", "value"])
