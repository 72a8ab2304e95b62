"""Personal data replaced by surrogates.

Detected entities are e-mail and IP addresses, phone and card numbers, access keys, secrets behind a name such as
``password=``, and persons behind a title.  An entity's normal form (digits alone, lower case, ...) is what counts
as the same entity; its surrogate is drawn from a keyed hash of type and normal form and has the same format: letters
for letters, digits for digits, separators as in the mention, valid check digits, octets within
range, and for persons given names of the title's gender and the name's script.

Distinctness is checked over the whole corpus: of the entities of a type that draw the same surrogate one keeps it,
the others draw again, as does whoever draws a real entity's normal form or a surrogate given before.  From every
fourth draw on the format is one character longer, so a format whose values are all in use ends too.  Coreference
holds as each mention of a normal form gets the one surrogate; first and last names are entities of their own, so
"Ms Ada Roe" and "Mrs Roe" share the last name.

Null texts stay null.  Texts without entities pass through as they are, without a shuffle.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, join_counted, with_key, written

EMAIL = regex.compile(r"[\p{L}\p{N}._%+-]*[\p{L}\p{N}_%+-]@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}")
ACCESS = regex.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)")
SECRET = regex.compile(r"(?i:(?<!\w)(?:password|passwd|pwd|token|secret|api[_-]?key))\s*[=:]\s*[\"']?([^\s\"',;]{6,})")
IP = regex.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
#: Candidates: Python's own parser decides.
IPV6 = regex.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{1,4}|(?<=::))(?!\w|:[0-9A-Fa-f:]|\.\d)")
CARD = regex.compile(r"(?<![\w.+-])(?:[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3\d{3}([ -])\d{6}\1\d{4,5})(?![\w]|[.-]\d)")
PHONE = regex.compile(
    r"(?<![\w.])(?:"
    r"(?:\+\d{1,3}[ .-]?|\d{1,3}[ .-])?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}"  # groups of at most four
    r"|(?<!\+)\+(?:\d{8,15}|\(?\d(?:[ .()/-]{0,3}\d){7,14})"  # a country's code, then any grouping
    r"|(?<!-)(?:\(0\d{1,4}\)[ ./-]?|0\d{1,4}[ ./-])\d{2,8}(?:([ .-])\d{2,8}(?:\1\d{2,8})*)?"  # a trunk 0: pairs, long groups
    r"|\(\d{2,4}\)[ .-]?\d{5,8}|(?<!-)\d{3}-\d{7}"
    r")(?![\w]|[.-]\d)")
#: Titles by gender: f, m.
TITLES = {"Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "госпожа": "f", "г-жа": "f",
          "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "господин": "m", "г-н": "m"}
PERSON = regex.compile(r"(?<!\w)(" + "|".join(map(regex.escape, TITLES)) + r")\.?[ \t]+(\p{Lu}[\p{L}'-]+)(?:[ \t]+(\p{Lu}[\p{L}'-]+))?")

#: Syllables of made-up names by script, and the endings of given names by gender.
SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga ge ha he jo ka ke ko la le lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split(),
              {"f": ["na", "ra", "lia", "sa"], "m": ["n", "rt", "s", "rd"], "": ["ner", "lin", "mond", "sen"]}),
    "cyrillic": ("ба бе бо да де до ва ве га ге ка ке ко ла ле ло ма ме ми мо на не ни но па пе ра ре ри ро са се та те ти".split(),
                 {"f": ["на", "ра", "лия", "са"], "m": ["н", "рт", "с", "р"], "": ["нов", "лин", "ренко", "ский"]}),
    "greek": ("βα βε γα γε δα δε θα κα κε λα λε λο μα με μι να νε νι πα πε ρα ρε ρι σα σε τα τε τι".split(),
              {"f": ["να", "ρα", "λια", "σα"], "m": ["νος", "ρης", "λας", "σης"], "": ["δης", "ρου", "πουλος", "νης"]}),
}


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    norm: str


def luhn_ok(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _ipv6(s: str) -> str | None:
    """The normal form of an address; none of ``::`` between few letters, as in code."""
    try:
        address = ipaddress.IPv6Address(s)
    except ValueError:
        return None
    if "::" in s and (sum(c in "0123456789abcdefABCDEF" for c in s) < 5 or not DIGIT.search(s)):
        return None
    return str(address)


def detect(text: str | None) -> list[Mention]:
    """Mentions in the order of the text; where two overlap, the kind that comes first here stands."""
    if not text:
        return []
    found: list[Mention] = []

    def add(start: int, end: int, kind: str, norm: str) -> None:
        found.append(Mention(start, end, kind, norm))

    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            if any(c.isalnum() for c in m[1]):  # a masked value is no secret
                add(m.start(1), m.end(1), "secret", m[1])
    if "AKIA" in text or "ASIA" in text:
        for m in ACCESS.finditer(text):
            add(m.start(), m.end(), "access", m[0])
    if "@" in text:
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email", m[0].lower())
    if "::" in text or text.count(":") > 5:
        for m in IPV6.finditer(text):
            if norm := _ipv6(m[0]):
                add(m.start(), m.end(), "ip", norm)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                add(m.start(), m.end(), "ip", ".".join(str(int(x)) for x in m[0].split(".")))
        for m in CARD.finditer(text):
            if 13 <= len(d := _digits(m[0])) <= 19 and luhn_ok(d):  # any other long number is no card
                add(m.start(), m.end(), "card", d)
        for m in PHONE.finditer(text):
            if (8 if m[0][0] == "+" else 9) <= len(d := _digits(m[0])) <= 15:
                add(m.start(), m.end(), "phone", d)
    if TITLE.search(text):
        for m in PERSON.finditer(text):
            if m[3]:
                add(m.start(2), m.end(2), f"given-{TITLES[m[1]]}", m[2].lower())
            last = 3 if m[3] else 2
            add(m.start(last), m.end(last), "name", m[last].lower())
    out: list[Mention] = []
    for m in found:  # kinds come in order of precedence
        if all(m.end <= o.start or m.start >= o.end for o in out):
            out.append(m)
    return sorted(out, key=lambda m: m.start)


DIGIT = regex.compile(r"\d")
TITLE = regex.compile("|".join(map(regex.escape, TITLES)))


class Draw:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        seed = hmac.new(key, f"{kind}\0{norm}\0{attempt}".encode(), hashlib.sha256).digest()
        self.state = int.from_bytes(hashlib.shake_256(seed).digest(24 + 2 * len(norm) + attempt), "big")

    def below(self, n: int) -> int:
        self.state, out = divmod(self.state, n)
        return out


def _script(word: str) -> str:
    for name, low, high in (("cyrillic", "Ѐ", "ӿ"), ("greek", "Ͱ", "Ͽ")):
        if any(low <= c <= high for c in word):
            return name
    return "latin"


def _like(c: str, draw: Draw) -> str:
    if c.isdigit():
        return str(draw.below(10))
    if "a" <= c <= "z":
        return chr(97 + draw.below(26))
    if "A" <= c <= "Z":
        return chr(65 + draw.below(26))
    return chr(97 + draw.below(26)) if c.isalpha() else c


def surrogate(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The normal form of the entity's surrogate; ``attempt // 4`` characters longer than the entity's."""
    draw = Draw(key, kind, norm, attempt)
    more = attempt // 4
    if kind == "email":
        local, domain = norm.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        return "".join(_like(c, draw) for c in "a" * more + local) + "@" + "".join(_like(c, draw) for c in host) + "." + top
    if kind == "ip":
        if ":" not in norm and attempt < 64:
            return ".".join(str(1 + draw.below(254)) for _ in range(4))
        return ":".join(f"{1 + draw.below(0xFFFF):x}" for _ in range(8))
    if kind == "card":
        body = norm[0] + "".join(str(draw.below(10)) for _ in norm[1:-1] + "0" * more)
        return next(body + d for d in "0123456789" if luhn_ok(body + d))
    if kind == "phone":
        trunk = min(len(norm) - len(norm.lstrip("0")), 2)
        code = trunk or max(len(norm) - 10, 0)  # leading zeros or the country's code stay
        return norm[:code] + str(2 + draw.below(8)) + "".join(str(draw.below(10)) for _ in norm[code + 1:] + "0" * more)
    if kind == "access":
        return norm[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw.below(32)] for _ in norm[4:] + "A" * more)
    if kind == "secret":
        hexadecimal = all(c in "0123456789abcdef" for c in norm)
        return "".join("0123456789abcdef"[draw.below(16)] if hexadecimal else _like(c, draw) for c in norm + "a" * more)
    syllables, endings = SYLLABLES[_script(norm)]
    gender = kind[6:] if kind.startswith("given-") else ""
    parts = [syllables[draw.below(len(syllables))] for _ in range(3 + more)]
    return "".join(parts) + endings[gender][draw.below(4)]


def render(mention: str, kind: str, norm: str) -> str:
    """The surrogate's normal form in the mention's format; of a longer one, further digits come last, letters first."""
    if kind in ("phone", "card"):
        digits = iter(norm)
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "email":
        more = max(len(norm) - len(mention), 0)
        return norm[:more] + "".join(n.upper() if c.isupper() else n for c, n in zip(mention, norm[more:]))
    if kind == "name" or kind.startswith("given-"):
        return norm.upper() if mention.isupper() and len(mention) > 1 else norm[:1].upper() + norm[1:]
    return norm


MENTIONS = "array<struct<start:int,end:int,kind:string,norm:string>>"


def _with_mentions(docs: DataFrame) -> DataFrame:
    """``doc_id, KEY, text, mentions`` of the rows that hold entities."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("norm", pa.string())]))
        for batch in batches:
            found = [[vars(m) for m in detect(t)] for t in batch.column(3).to_pylist()]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], ["doc_id", *KEY, "text", "mentions"])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return _plain(docs).mapInArrow(kernel, f"doc_id long, _id long, _h long, text string, mentions {MENTIONS}")


def _plain(docs: DataFrame) -> DataFrame:
    return with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", *KEY, "text")


def _draws(entities: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            drawn = [surrogate(key, k, n, attempt) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(drawn, pa.string())], ["kind", "norm", "n", "surrogate"])

    return entities.select("kind", "norm", "n").mapInArrow(kernel, "kind string, norm string, n long, surrogate string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, norm, n, surrogate``: distinct surrogates within a kind, none of them a normal form of the corpus.

    ``entities`` (``kind, norm, n``) is a written table.  Each round settles all that drew alone; the number of the
    others falls with the share of the format's space that is in use, and the formats widen, so that all end.
    """
    real = entities.select("kind", F.col("norm").alias("surrogate"))
    done = None
    todo, attempt = entities, 0
    while True:
        drawn = written(_draws(todo, key, attempt), "pii-draws")
        taken = real if done is None else real.unionByName(done.select("kind", "surrogate"))
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min(F.struct("norm", "n")).alias("e"))
        won = first.select("kind", "e.norm", "e.n", "surrogate")
        done = written(won if done is None else done.unionByName(won), "pii-surrogates")
        left = written(drawn.join(done, ["kind", "norm"], "left_anti").select("kind", "norm", "n"), "pii-left")
        if not left.limit(1).count():
            return done
        todo, attempt = left, attempt + 1


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, entities`` per row: the text with surrogates, and what stands where in it."""
    found = written(_with_mentions(docs), "pii-documents")
    mentions = found.select(*KEY, F.explode("mentions").alias("m")).select(*KEY, "m.*").distinct()
    mentions = written(mentions.withColumn("entity", F.xxhash64("kind", "norm")), "pii-mentions")
    entities = written(mentions.groupBy("kind", "norm").agg(F.count("*").alias("n")), "pii-entities")
    given = assign(entities, key).select(F.xxhash64("kind", "norm").alias("entity"), F.col("kind").alias("k"), F.col("norm").alias("r"), "n", "surrogate")
    named = join_counted(mentions, written(given, "pii-given"), "entity", "n", entities.agg(F.sum("n")).first()[0] or 0)
    named = named.where("kind = k and norm = r").groupBy(*KEY).agg(F.collect_list(F.struct("start", "end", "kind", "surrogate")).alias("names"))

    def rewrite(batches: Iterator[pa.RecordBatch]):
        entity = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("surrogate", pa.string())]))
        for batch in batches:
            texts, marks = [], []
            for text, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at, size, mark = [], 0, 0, []
                for m in sorted(names, key=lambda m: m["start"]):
                    new = render(text[m["start"]:m["end"]], m["kind"], m["surrogate"])
                    parts += [text[at:m["start"]], new]
                    size += m["start"] - at
                    mark.append({"kind": m["kind"], "start": size, "surrogate": new})
                    size += len(new)
                    at = m["end"]
                texts.append("".join(parts) + text[at:])
                marks.append(mark)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(marks, entity)], ["doc_id", "text", "entities"])

    schema = "doc_id long, text string, entities array<struct<kind:string,start:int,surrogate:string>>"
    changed = found.drop("mentions").join(named, KEY).select("doc_id", "text", "names").mapInArrow(rewrite, schema)

    def untouched(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.filter(pa.array([not detect(t) for t in batch.column(1).to_pylist()], pa.bool_()))

    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(untouched, "doc_id long, text string")
    return changed.unionByName(rest.withColumn("entities", F.expr("cast(array() as array<struct<kind:string,start:int,surrogate:string>>)")))


def digests(replaced: DataFrame) -> DataFrame:
    """What the query returns."""
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return replaced.select("doc_id", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"), "text")
