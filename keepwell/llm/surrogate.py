"""Personal data replaced by surrogates.

Entities are detected with their type and a normal form, in which spellings of the same
entity agree.  A surrogate is drawn by a keyed hash of type, normal form and attempt:
letters become letters of the same script and case, digits digits, checksums stay valid
or invalid, an address keeps its class, a domain its ending, a given name its gender.
The surrogate of the normal form is then written the way the entity was.

Distinct entities keep distinct surrogates, and no surrogate is an entity of the corpus:
the distinct entities of all documents draw in rounds, in each of which those that drew
an entity, a surrogate that is given away, or the same as a lesser entity draw again.
Only entities that needed more than the first attempt must be looked up when the
documents are rewritten; they are few, as formats have room.  Up to `SENT_ROWS` of them
are sent to the tasks, more are joined by document.

A name found beside a title or a listed given name is replaced at its other capitalized
mentions in the same document, too.

Defined cases: null and empty texts have no entities and stay as they are; rows of equal
id and text get equal results, also where the id is null; other columns pass through,
and new columns replace columns of their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hmac
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell.llm.common import quoted, rows_back, saved, text_batches, whole_rows

#: Entities with later attempts that are sent to every task, at most.
SENT_ROWS = 100_000
#: Attempts after which a surrogate gets a character more for each further one, so that formats never run out.  Addresses
#: can't get longer: those in 192.168/16 then leave it for 10/8, and after as many attempts again all become unique local IPv6.
LONGER_FROM = 12
#: Rounds of draws after which something else than chance must be wrong.
MOST_ROUNDS = 200

#: Titles and common given names, by gender.
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f",
          "Dr": "n", "Prof": "n"}
GIVEN = {**dict.fromkeys("James John Robert Michael William David Richard Thomas Charles Daniel Matthew Peter Paul George "
                         "Hans Klaus Jürgen Stefan Pierre Jacques François Carlos José Miguel Иван Дмитрий Алексей".split(), "m"),
         **dict.fromkeys("Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Laura Alice Julia "
                         "Petra Sabine Ursula Monika Marie Sophie Claire Carmen Lucía Elena Мария Ольга Татьяна".split(), "f")}
#: Lower-case letters of the scripts that surrogates are made of; capitals follow from them.
SCRIPTS = ("abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýœß", "абвгдежзиклмнопрстуфхцчшщэюя",
           "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
           "".join(map(chr, range(0x3042, 0x3094))), "".join(map(chr, range(0x30A2, 0x30F4))),
           "".join(map(chr, range(0x4E00, 0x5E00))), "".join(map(chr, range(0xAC00, 0xBC00))))
SCRIPT_OF = {c: s for s in SCRIPTS for c in s}
#: Ends of given names, by gender, for the scripts that tell.
NAME_ENDS = {("m", SCRIPTS[0]): ("an", "or", "ert", "on"), ("f", SCRIPTS[0]): ("a", "ia", "elle", "ina"),
             ("m", SCRIPTS[2]): ("ан", "ор", "ил"), ("f", SCRIPTS[2]): ("а", "ина", "ия")}

NUMERIC = re.compile(r"""
    (?P<email>(?<![\w.+-])[\w.+-]*\w@(?:[\w-]+\.)+[^\W\d_]{2,})
  | (?P<secret>\b(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b | \b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{36,}|sk-\w{20,})\b
             | (?<=["'])(?=[^"'\s]*\d)(?=[^"'\s]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}(?=["']))
  | \b(?i:password|passwd|pwd|passphrase|secret|token|credential|api[_-]?key|access[_-]?key|auth[_-]?key)s?\s*[=:]\s*["']?
      (?P<assigned>(?=[^\s"'<>,;]*\d)[^\s"'<>,;]{6,})
  | (?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.]*\d))
  | (?P<iban>\b[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?\b)
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<card>(?<![\w.+-])(?:\d{13,19} | \d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})? | \d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d))
  | (?P<phone>(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3,4}[ .-]\d{3,4}(?!\w)
            | (?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w))
""", re.X)
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-Я][\w'’-]+"
#: Words that open a sentence behind a title's point ("Prof. The"); further mentions of them are no names.
NO_NAMES = frozenset("the a an and but or if in on at to of for from by with as he she it we you they this that these those his her "
                     "its our your their my not no so then there when where who what why how is was are were has have had will "
                     "der die das ein eine und er sie es wir le la les un une et il elle el los las una y".split())
#: Without one of these a text can't hold an entity; both are found fast.
_DIGIT, _HINT = re.compile(r"[0-9@]"), re.compile("|".join([*TITLES, *GIVEN]))
POSSESSIVE = re.compile(r"(?<=\w\w)['’]s$")
NAMED = re.compile(rf"\b(?:(?P<title>{'|'.join(TITLES)})\.?[ ](?P<first>{_CAPITAL})(?:[ ](?P<last>{_CAPITAL}))?"
                   rf"|(?P<given>{'|'.join(GIVEN)})[ ](?P<family>{_CAPITAL}))")


def _plain_digits(x: str) -> str:
    return "".join(c for c in x if c.isdigit())


def normal(kind: str, text: str) -> str:
    """The form in which spellings of one entity agree."""
    if kind in ("card", "ssn"):
        return _plain_digits(text)
    if kind == "phone":
        return ("+" if text.startswith("+") else "") + _plain_digits(text)
    if kind == "iban":
        return text.replace(" ", "")
    return text if kind in ("secret", "ip") else text.lower()


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) in order, none overlapping."""
    if not text:
        return []
    found = []
    if _DIGIT.search(text):
        for m in NUMERIC.finditer(text):
            kind, own = m.lastgroup, m[m.lastgroup]
            if kind == "ip" and max(map(int, own.split("."))) > 255:
                continue
            span, kind = m.span(kind), "secret" if kind == "assigned" else kind
            found.append((*span, kind, normal(kind, own)))
    names = []
    for m in NAMED.finditer(text) if _HINT.search(text) else ():
        gender = TITLES[m["title"]] if m["title"] else GIVEN[m["given"]]
        if m["title"] and not m["last"]:
            parts = [("first", "family")]
        elif m["title"]:
            parts = [("first", f"given-{GIVEN.get(m['first'], gender)}"), ("last", "family")]
        else:
            parts = [("given", f"given-{gender}"), ("family", "family")]
        for g, kind in parts:
            own = POSSESSIVE.sub("", m[g])
            names.append((m.start(g), m.start(g) + len(own), kind, normal(kind, own)))
    if not names:
        return found
    return _placed(found, names + _mentions(text, names))


def _placed(found: list, names: list) -> list:
    """All in order, without names that overlap what was found before, or a name before them in the list."""
    taken = sorted((a, b) for a, b, _, _ in found)
    out = list(found)
    for n in names:
        at = bisect_left(taken, (n[1],))
        if not at or taken[at - 1][1] <= n[0]:
            insort(taken, (n[0], n[1]))
            out.append(n)
    return sorted(out)


def _mentions(text: str, names: list) -> list:
    """Further capitalized mentions of the names found in the text, each as the entity it was first found as."""
    known: dict[str, str] = {}
    for _, _, kind, form in names:
        # A name that is given somewhere is that of the same person where it stands alone.
        if form not in NO_NAMES and (form not in known or known[form] == "family" and kind != "family"):
            known[form] = kind
    if not known:
        return []
    pattern = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?!\w)", re.I)
    return [(m.start(), m.end(), known[m[0].lower()], m[0].lower()) for m in pattern.finditer(text)
            if m[0][0].isupper() and m[0].lower() in known]


class Draw:
    """An endless run of numbers from a keyed hash."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.at = key, "\x00".join(map(str, what)).encode(), 0
        self.pool, self.left = 0, 0

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            self.pool = int.from_bytes(hmac.digest(self.key, self.what + self.at.to_bytes(4, "big"), "sha256"), "big")
            self.left, self.at = 1 << 256, self.at + 1
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out


def _like(draw: Draw, c: str) -> str:
    """A character of the same script and case; what is neither letter nor digit stays."""
    if c.isdecimal():
        return str(draw.below(10))
    low = c.lower()
    if not c.isalpha() or len(low) != 1:
        return c
    pool = SCRIPT_OF.get(low, SCRIPTS[0])
    out = pool[draw.below(len(pool))]
    return out.upper() if c != low and len(out.upper()) == 1 else out


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def surrogate(key: bytes, kind: str, form: str, attempt: int) -> str:
    """The normal form's surrogate at this attempt, itself in normal form."""
    draw = Draw(key, kind, form, attempt)
    more = "0" * max(0, attempt - LONGER_FROM)
    if kind == "email":
        local, _, domain = form.rpartition("@")
        own = Draw(key, "domain", domain)
        labels, _, ending = domain.rpartition(".")
        return "".join(_like(draw, c) for c in local + more) + "@" + "".join(_like(own, c) for c in labels) + "." + ending
    if kind == "ip":
        a, b, c, d = map(int, form.split("."))
        if attempt >= 2 * LONGER_FROM:
            return "fd" + ":".join(f"{draw.below(1 << 16):04x}" for _ in range(8))[2:]
        kept = [a] if a in (10, 127) else [] if (a, b) != (192, 168) else [a, b] if attempt < LONGER_FROM else [10]
        low = 0 if kept else 11
        first = kept or [low + draw.below(116)]
        return ".".join(map(str, [*first, *(1 + draw.below(254) for _ in range(4 - len(first)))]))
    if kind == "card":
        body = form[0] + "".join(str(draw.below(10)) for _ in form[1:-1] + more)
        ok = next(d for d in "0123456789" if luhn(body + d))
        return body + (ok if luhn(form) else str((int(ok) + 1 + draw.below(9)) % 10))
    if kind == "ssn":
        return "".join(str(draw.below(10)) for _ in form + more)
    if kind == "phone":
        plus = form.startswith("+")
        kept = form[:2] if plus else ""
        return kept + "".join(str(draw.below(9) + 1 if i == 0 else draw.below(10)) for i, _ in enumerate(form[len(kept):] + more))
    if kind == "iban":
        return form[:2] + "".join(_like(draw, c) for c in form[2:] + more)
    if kind == "secret":
        hexadecimal = "0123456789abcdef" if re.fullmatch("[0-9a-f]+", form) else "0123456789ABCDEF" if re.fullmatch("[0-9A-F]+", form) else ""
        kept = next((p for p in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-") if form.startswith(p)), "")
        return kept + "".join(hexadecimal[draw.below(16)] if hexadecimal else _like(draw, c) for c in form[len(kept):] + more)
    # Names: letters of the script; given names end as their gender does.
    body = "".join(_like(draw, c) for c in form + "a" * len(more))
    ends = NAME_ENDS.get((kind[6:], SCRIPT_OF.get(form[:1], SCRIPTS[0]))) if kind.startswith("given-") else None
    if ends:
        end = ends[draw.below(len(ends))]
        body = body[:max(3, len(body) - len(end))] + end
    return body


def written(form: str, surface: str, kind: str) -> str:
    """The surrogate's normal form in the spelling of the entity it replaces."""
    if kind in ("secret", "ip"):
        return form
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(form.lstrip("+") if kind == "phone" else form)
        out = "".join(next(rest, "") if c.isalnum() else c for c in surface)
        return out + "".join(rest)
    out = [s.upper() if c.isupper() and len(s.upper()) == 1 else s for s, c in zip(form, surface.ljust(len(form), "a"))]
    return "".join(out)


def _norm_columns(df: DataFrame, key: str, text: str) -> DataFrame:
    return whole_rows(df, id=key, text=text).withColumn("mark", F.xxhash64("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, mark, kind, form): each document's distinct entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, forms = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for kind, form in sorted({(k, f) for _, _, k, f in entities(t)}):
                    at.append(i)
                    kinds.append(kind)
                    forms.append(form)
            pick = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), batch.column("mark").take(pick),
                                              pa.array(kinds, pa.string()), pa.array(forms, pa.string())], ["id", "mark", "kind", "form"])

    rows = docs.select(F.col("id").cast("string").alias("id"), "mark", "text")
    return rows.mapInArrow(run, "id string, mark long, kind string, form string")


def attempts(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, attempt) of the distinct entities whose first surrogate was taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [surrogate(key, k, f, a) for k, f, a in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], [*batch.schema.names, "drawn"])

    # Given names of either gender and family names share their pool.
    pool = F.when(F.col("kind").startswith("given-") | (F.col("kind") == "family"), "name").otherwise(F.col("kind")).alias("pool")
    real, _ = saved(found.select("kind", "form").distinct(), "entities")
    taken = real.select(pool, F.col("form").alias("drawn")).distinct()
    waiting, settled = real.withColumn("attempt", F.lit(0)), None
    rounds = 0
    while waiting.first() is not None:
        if (rounds := rounds + 1) > MOST_ROUNDS:
            raise ValueError(f"{waiting.count()} entities without a surrogate after {MOST_ROUNDS} rounds")
        tried, _ = saved(waiting.mapInArrow(run, "kind string, form string, attempt int, drawn string")
                         .withColumn("pool", pool), "surrogates")
        free = tried.join(taken, ["pool", "drawn"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("pool", "drawn"), ["pool", "drawn"], "left_anti")
        won, _ = saved(free.groupBy("pool", "drawn").agg(F.min(F.struct("kind", "form", "attempt")).alias("of"))
                       .select("of.kind", "of.form", "of.attempt", "pool", "drawn"), "surrogates-given")
        settled = won if settled is None else settled.unionByName(won)
        waiting, _ = saved(tried.join(won, ["kind", "form"], "left_anti")
                           .select("kind", "form", (F.col("attempt") + 1).alias("attempt")), "entities-waiting")
    return real.limit(0).withColumn("attempt", F.lit(0)) if settled is None \
        else settled.where("attempt > 0").select("kind", "form", "attempt")


def replace_entities(df: DataFrame, key: bytes, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with `text` rewritten, and the columns n_entities and entity_types (distinct, sorted, comma-joined)."""
    spark = df.sparkSession
    text_batches(spark)
    docs = _norm_columns(df, id, text)
    found, _ = saved(occurrences(docs.select("id", "mark", "text")), "entity-places")
    later, _ = saved(attempts(found, key), "later-attempts")
    sent = None
    if later.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        sent = spark.sparkContext.broadcast({(r.kind, r.form): r.attempt for r in later.collect()})
        rows = docs.select("row", "text", F.lit(None).cast("array<struct<kind:string,form:string,attempt:int>>").alias("later"))
    else:
        of = found.distinct().join(later, ["kind", "form"]).groupBy("id", "mark") \
            .agg(F.collect_set(F.struct("kind", "form", "attempt")).alias("later")).withColumnsRenamed({"id": "their_id", "mark": "their_mark"})
        on = F.col("id").cast("string").eqNullSafe(F.col("their_id")) & (F.col("mark") == F.col("their_mark"))
        rows = docs.join(of, on, "left").select("row", "text", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            for t, own in zip(batch.column("text").to_pylist(), batch.column("later").to_pylist()):
                tries = {(x["kind"], x["form"]): x["attempt"] for x in own} if own else sent.value if sent else {}
                places, parts, at = entities(t), [], 0
                for a, b, kind, form in places:
                    parts += [t[at:a], written(surrogate(key, kind, form, tries.get((kind, form), 0)), t[a:b], kind)]
                    at = b
                texts.append("".join([*parts, t[at:]]) if places else t)
                counts.append(len(places))
                kinds.append(",".join(sorted({k.partition("-")[0] for _, _, k, _ in places})))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                                              pa.array(kinds, pa.string())], ["row", "text", "n", "kinds"])

    slim = rows.withColumn("row", F.col("row").withField(quoted(text), F.lit(None).cast("string")))
    shape = T.StructType([slim.schema["row"], T.StructField("text", T.StringType()), T.StructField("n", T.LongType()),
                          T.StructField("kinds", T.StringType())])
    done = slim.mapInArrow(run, shape)
    return rows_back(done, df, **{text: F.col("text"), "n_entities": F.col("n"), "entity_types": F.col("kinds")})
