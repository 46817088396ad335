"""Personal information in free text: found, typed and replaced by placeholders (problem 4).

Anchor expansion: one Aho-Corasick pass over the lower-cased text finds at-signs, schemes, cues of
identity numbers, street words, given names and name cues; a name cue makes a full name of any
capitalised pair after it, a known given name also without one; a deterministic parser at each anchor
expands to the item's boundaries and validates it. Digit runs are the anchors of phone numbers.

Given names are known from a short list of common ones and from the corpus itself (``learned``): a word
that stands first in full names after cues in ``LEARN_TEXTS`` places, with ``LEARN_FAMILIES`` family names, is a
given name wherever it stands. At most ``LEARN_NAMES`` are kept, the most frequent, so that the
automaton that every task gets has a bound; all texts are read for this.

Defined results: null text stays null and holds nothing; overlapping finds keep the kind that comes
first in ``KINDS``; repeated items give one span each; placeholders already in the text, handles,
version and order numbers, single names and names of apps hold nothing. A full name whose given name is
not known is found only at a name cue, and in lower case only after ``SIGNED``; see the README for
the recall of that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "id_number", "phone", "street_address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# Common given names of several languages; the corpus adds its own (``learned``).
GIVEN = (
    "aaron ahmed aisha alberto alejandro alessandro alexander amanda amara amy ana andreas andrew angela angelika anja anjali anna "
    "anthony antonio arjun ashley astrid barbara benjamin björn brian carlos carmen carol charles charlotte chiara christine "
    "christopher claire clara claudia cristina daniel david deepak diego dmitri donald edward ekaterina elena elizabeth emily emma "
    "eric fatima felix fernanda fernando florian francesca francisco franziska françois george giovanni giulia giuseppe gregory hana "
    "hannah hassan helen henrik henry hiroshi hugo ibrahim ingrid isabel ivan jacob jacques james jason javier jean jeffrey jennifer "
    "jessica johanna john jonathan jorge jose joseph joshua josé joão juan julia justin jürgen karen katarzyna katherine katrin keiko "
    "kenneth kevin klaus lakshmi lars laura layla lena leon linda lisa luca luis lukas manuel marco maria mariana marie markus martin "
    "mary matthew matthias mei melissa michael michelle miguel mikhail mohamed mohammed monika moritz mustafa nancy natasha nathalie "
    "nguyen nicholas nicole olga oliver omar pablo patricia patrick paul paulo peter petra philippe pierre piotr priyanka rachel "
    "rafael rahul rebecca robert ryan sabine samantha sanjay sarah sebastian sergei sofia stefan stephanie stephen steven susan "
    "susanne sven takashi teresa thomas timothy tobias tyler ursula valentina vladimir wei william wolfgang yoko yuki zofia"
).split()
# Words before a full name.
NAME_CUES = (
    "asked", "tell", "sincerely,", "signed for by", "called me", "my ex (", "knows", "on the form:", "name is", "sound like",
    "landlord,", "frag bitte", "heiße", "heisse", "dr.", "me llamo", "regards,", "mrs.", "mr.", "ms.", "frau", "herr", "señora", "señor",
)
STRONG_CUES = ("sincerely,", "signed for by", "on the form:", "real name is", "frag bitte", "ich heiße", "me llamo", "sound like")
#: Any capitalised pair after these is a full name, whatever its given name; words must begin a word.
NAME_FRAMES = (
    "tell", "told", "ask", "asked", "asks", "know", "knows", "knew", "met", "meet", "called me", "calls me", "named", "thank", "thanks to",
    "emailed", "texted", "visited", "married", "dear", "sounds like", "signed by", "written by", "sent by", "on behalf of", "name is", "name was",
    "name:", "i am", "i'm", "this is", "regards,", "yours,", "love,", "cheers,", "dr.", "mr.", "mrs.", "ms.", "prof.", "frau", "herr", "herrn", "señora",
    "señor", "don", "doña", "fragte", "frage", "frag", "kennt", "mein name ist", "ich bin", "grüße,", "viele grüße", "liebe", "lieber", "heiße", "heisse",
    "pregunta a", "pregunté a", "dile a", "conoce a", "mi nombre es", "soy", "saludos,", "atentamente,", "querida", "querido",
    *(r + t for r in (
        "landlord", "landlady", "friend", "boss", "manager", "teacher", "therapist", "doctor", "nurse", "lawyer", "neighbour", "neighbor", "colleague",
        "coworker", "roommate", "flatmate", "husband", "wife", "partner", "boyfriend", "girlfriend", "fiancé", "fiancée", "ex", "brother", "sister", "mother",
        "father", "son", "daughter", "cousin", "uncle", "aunt", "freund", "freundin", "chef", "chefin", "nachbar", "nachbarin", "bruder", "schwester",
        "amigo", "amiga", "jefe", "jefa", "vecino", "vecina", "hermano", "hermana", "marido", "mujer", "esposa",
    ) for t in ("", ",", " (")),
)
#: Frames that are capitalised within a sentence, too.
CAPITALS = frozenset(
    "dr. mr. mrs. ms. prof. frau herr herrn freund freundin chef chefin nachbar nachbarin bruder schwester grüße,".split()
) | {"i am", "i'm"}
#: After these a name may also stand in lower case or family name first.
SIGNED = ("sincerely,", "signed for by", "on the form:", "real name is", "name is", "regards,", "ich heiße", "me llamo", "frag bitte")
# Capitalised words that no person's full name begins or ends with.
NOT_NAMES = frozenset(
    "dr mr mrs ms miss prof professor sir frau herr herrn señor señora doctor nurse officer mom mum dad grandma grandpa aunt uncle me more them "
    "yours truly everyone someone everything nothing there here please today tomorrow yesterday now so because just no yes how what why where "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag lunes martes miércoles jueves viernes sábado domingo google microsoft apple amazon "
    "facebook openai chatgpt chat gpt claude gemini siri alexa assistant bot ai customer service support team new san santa los las united north south "
    "east west street road avenue lane university college hospital company bank ich du er sie wir ihr mich dich uns nach bitte".split()
)
PARTICLES = "van|von|der|den|de|del|la|da|di|du|le|dos"
# Words that follow a single name, so that the two are no full name.
NOT_SURNAMES = frozenset(
    "called calls said says told asked wrote and or but the a an is was has had will would could can again about that who which "
    "in on at for with from to of as if when then than my your his her their our it he she they we i you not never always also "
    "und oder aber ist war hat rief sagte der die das ein eine y o pero es fue ha llamó dijo el los las un una que read street road".split()
)
# Cues of identity numbers, before or after the number.
ID_CUES = (
    "ssn", "social security", "my social", "passport", "ausweis", "national id", "identity card", "member id", "member no", "id number",
    "reisepass", "pasaporte", "dni", "sozialversicherung", "seguridad social", "insurance card", "tax id", "carnet",
)
PHONE_CUES = re.compile(
    r"(?:phone|telefon|teléfono|tel|call me on|call|number is|cell|texted|text|ruf mich unter|unter|mobil|móvil|handy|fax|whatsapp|llámame al)[\s.:(]*$", re.I
)
STREET_EN = ("street", "st", "road", "rd", "lane", "ln", "avenue", "ave", "crescent", "cres", "drive", "court", "square", "boulevard", "blvd", "terrace", "way")
STREET_DE = ("straße", "strasse", "str.", "gasse", "allee", "weg", "platz", "damm", "ufer")
STREET_ES = ("calle", "avenida", "plaza", "paseo")
_NOT_STREET = frozenset("of the on my in and to a an at for from with by is was were are steps this that our your his her their out no".split())

_LOCAL = re.compile(r"[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ._%+'-]*[A-Za-z0-9À-ÿ_+-])?$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?|\s+dot\s+)[A-Za-z0-9-]+)*(?:\.|\s?[(\[]dot[)\]]\s?|\s+dot\s+)[A-Za-z]{2,}", re.I)
_ID = re.compile(r"(?<![\w-])(?:[A-Za-z]{1,3}[ -]?)?\d{2,}(?:[ .-]\d+)*(?:[ .-]?[A-Za-z](?!\w))?(?![\w@])")
_SSN = re.compile(r"(?<![\w.,-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w.,#@/+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?)?\d(?:[ ./-]{0,3}\d){5,14}(?:\s*(?:ext\.?|x)\s*\d{1,5})?(?![\w@])", re.I)
_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}(?!\d)")
_NANP = re.compile(r"\(?\d{3}\)?[ .-]{1,3}\d{3}[ .-]{1,3}\d{4}|\d(?: \d){9}")
_NUMBER_BACK = re.compile(r"(?<![\w.,-])\d{1,5}[A-Za-z]?\s+((?:[^\W\d_][\w'’-]*\s+){1,3})$")
_DE_BACK = re.compile(r"[^\W\d_][\w-]*$")
_DE_FORE = re.compile(r"\s+\d{1,4}\s?[a-z]?(?!\w)", re.I)
_ES_FORE = re.compile(r"(?:\s+[^\W\d_][\w'’-]*){1,4},?\s+\d{1,4}(?!\w)")
_UNIT = re.compile(r",?\s+(?:apt|apartment|unit|suite|flat)\.?\s*\w{1,5}", re.I)
_WORD = r"[^\W\d_]['’]?[^\W\d_]+(?:[-'’][^\W\d_]['’]?[^\W\d_]*)*"
_AFTER = re.compile(rf"\s+(?:[^\W\d_]\.\s+)?(?:(?:{PARTICLES})\s+){{0,2}}({_WORD})", re.I)
_BEFORE = re.compile(rf"((?:(?:{PARTICLES})\s+){{0,2}}({_WORD})),\s+$", re.I)
_FULL = re.compile(rf"\s*({_WORD})(?:\s+[^\W\d_]\.)?(?:\s+(?:{PARTICLES})){{0,2}}\s+({_WORD})", re.I)
_REVERSED = re.compile(rf"\s*((?:(?:{PARTICLES})\s+){{0,2}}({_WORD})),\s+({_WORD})(?=[.,;:!?)\n]|\s+(?:und|y)\s|$)", re.I)
_NEXT_WORD = re.compile(r"\s+([^\W\d_])")
_NEXT_SENTENCE = re.compile(r"(?<!\bno)(?<!\bnr)[.!?]\s+[^\W\d_]", re.I)
_DIGIT = re.compile(r"\d")


#: A given name is learned from this many places with this many family names; the most frequent ones are kept.
LEARN_TEXTS, LEARN_FAMILIES, LEARN_NAMES = 4, 3, 20_000


@lru_cache(2)
def anchors(names: tuple[str, ...] = ()):
    """The automaton of all anchors, with learned given names."""
    import ahocorasick

    made = ahocorasick.Automaton()
    words: dict[str, list[tuple[str, str]]] = {}
    for kind, group in (
        ("email", ("@", "(at)", "[at]")), ("id", ID_CUES), ("en", STREET_EN), ("de", STREET_DE), ("es", STREET_ES),
        ("given", tuple(dict.fromkeys((*GIVEN, *names)))), ("cue", STRONG_CUES), ("frame", tuple(dict.fromkeys(NAME_FRAMES + SIGNED))),
    ):
        for w in group:
            words.setdefault(w, []).append((kind, w))
    for w, kinds in words.items():
        made.add_word(w, kinds)
    made.make_automaton()
    return made


def _style(word: str) -> str:
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return "upper"
    return "title" if letters and letters[0].isupper() else "lower"


def _cued(low: str, at: int) -> bool:
    return low[max(0, at - 20) : at].rstrip().endswith(NAME_CUES) or low[max(0, at - 20) : at].endswith("(")


def _email(text: str, at: int, sign: str):
    left, right = text[max(0, at - 80) : at], at + len(sign)
    gap = left.endswith(" ")
    local = _LOCAL.search(left.rstrip(" ") if gap else left)
    if not local:
        return None
    if text[right : right + 1] == " ":
        if not gap:
            return None
        right += 1
    elif gap:
        return None
    domain = _DOMAIN.match(text, right)
    if not domain:
        return None
    start = at - len(left) + local.start()
    return start, domain.end()


def _ids(text: str, low: str, cue_at: int, cue: str, out: list) -> None:
    """The number that stands next after a cue in its sentence, or just before one."""
    end = cue_at + len(cue)
    for m in _ID.finditer(text, end, end + 60):
        if _NEXT_SENTENCE.search(text, end, m.start()):
            break
        if sum(c.isdigit() for c in m.group()) >= 6 and not _DATE.fullmatch(m.group()):
            out.append((m.start(), m.end(), "id_number"))
            return
    if cue == "my social":
        for m in _ID.finditer(text, max(0, cue_at - 24), cue_at):
            if sum(c.isdigit() for c in m.group()) >= 6:
                out.append((m.start(), m.end(), "id_number"))


def _phones(text: str, out: list) -> None:
    for m in _PHONE.finditer(text):
        s = m.group()
        digits = sum(c.isdigit() for c in s)
        if not 7 <= digits <= 18 or _DATE.match(s) or _SSN.fullmatch(s):
            continue
        cue = PHONE_CUES.search(text[max(0, m.start() - 20) : m.start()])
        core = re.sub(r"(?i)\s*(?:ext\.?|x)\s*\d+$", "", s)
        if core[0] == "+" or cue or _NANP.fullmatch(core) or (core[0] == "0" and digits >= 9 and not core.replace("0", "").isspace()):
            out.append((m.start(), m.end(), "phone"))
        elif core[0] == "(" and digits >= 9:
            out.append((m.start(), m.end(), "phone"))


def _street(text: str, low: str, at: int, word: str, kind: str):
    end = at + len(word)
    if kind == "en":
        if (at and not low[at - 1].isspace()) or (end < len(low) and (low[end].isalnum() or low[end] == "_")):
            return None
        m = _NUMBER_BACK.search(text[max(0, at - 60) : at])
        if not m or any(w in _NOT_STREET for w in m[1].lower().split()):
            return None
        start = max(0, at - 60) + m.start()
        unit = _UNIT.match(text, end + (text[end : end + 1] == "."))
        return start, unit.end() if unit else end
    if kind == "de":
        m, n = _DE_BACK.search(text[max(0, at - 40) : at]), _DE_FORE.match(text, end)
        return (max(0, at - 40) + m.start(), n.end()) if m and n else None
    if at and low[at - 1].isalnum():
        return None
    n = _ES_FORE.match(text, end)
    return (at, n.end()) if n else None


def _name(text: str, low: str, at: int, given: str):
    end = at + len(given)
    if (at and (low[at - 1].isalnum() or low[at - 1] in "_@.-")) or (end < len(low) and (low[end].isalnum() or low[end] == "_")):
        return None
    style = _style(text[at:end])
    m = _AFTER.match(text, end)
    if m and m[1].lower() not in NOT_SURNAMES and len(m[1]) > 2 and (_style(m[1]) == style or (style == "title" and m[1][0].isupper())):
        if style != "lower" or _cued(low, at):
            return at, m.end()
    m = _BEFORE.search(text[max(0, at - 60) : at])
    if m and m[2].lower() not in NOT_SURNAMES and _style(m[2]) == style:
        start = max(0, at - 60) + m.start()
        closed = end >= len(text) or text[end] in ".,;:!?)\n"
        if _cued(low, start) or (closed and style != "lower" and start and text[start - 1] in "(\n"):
            return start, end
    return None


def _framed(text: str, low: str, at: int, frame: str):
    """The full name after a frame, whatever its given name."""
    end = at + len(frame)
    if at and (low[at - 1].isalnum() or low[at - 1] in "_@'’"):
        return None
    if frame[-1].isalnum() and not text[end : end + 1].isspace():
        return None
    written = text[at:end]
    if written not in (frame, frame.capitalize(), frame.upper()):
        return None
    before = text[max(0, at - 20) : at].rstrip(" \t")
    if written[0].isupper() and not written.isupper() and frame not in CAPITALS and before and before[-1] not in ".!?:;,\n([{<>\"“„'*-—":
        return None  # a title or a text whose words are all capitalised
    signed = frame in SIGNED
    shouted = written.isupper() and len(written) > 1
    m = _FULL.match(text, end)
    if m and (n := _NEXT_WORD.match(text, m.end())) and n[1].isupper() and _style(m[2]) == "title":
        m = None
    if m and min(len(m[1]), len(m[2])) > 2 and not {m[1].lower(), m[2].lower()} & (NOT_SURNAMES | NOT_NAMES):
        given, family = _style(m[1]), _style(m[2])
        if family != "lower" and (given == "title" or given == family == "upper" and not shouted):
            return m.start(1), m.end()
        if signed and given == family == "lower" and (m.end() == len(text) or text[m.end()] in ".,;!?)\n"):
            return m.start(1), m.end()
    m = _REVERSED.match(text, end) if signed else None
    if m and not {m[2].lower(), m[3].lower()} & (NOT_SURNAMES | NOT_NAMES) and _style(m[2]) == _style(m[3]) != "lower":
        return m.start(1), m.end()
    return None


def _low(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # keep offsets where a letter's lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def named_people(text: str) -> list[tuple[str, str]]:
    """(given name, family name) in lower case of the capitalised full names after cues."""
    low, out = _low(text), set()
    for last, kinds in _frames().iter(low):
        for _, word in kinds:
            hit = _framed(text, low, last - len(word) + 1, word)
            if hit:
                name = text[hit[0] : hit[1]]
                family, _, given = name.partition(",") if "," in name else (name.split()[-1], "", name.split()[0])
                given = given.strip()
                if given[:1].isupper():
                    out.add((hit[0], given.lower(), family.split()[-1].lower()))
    return [(g, f) for _, g, f in sorted(out)]


@lru_cache(1)
def _frames():
    import ahocorasick

    made = ahocorasick.Automaton()
    for w in dict.fromkeys(NAME_FRAMES + SIGNED):
        made.add_word(w, [("frame", w)])
    made.make_automaton()
    return made


def learned(df: DataFrame, content: str = "content") -> tuple[str, ...]:
    """Given names that the corpus itself shows, at most ``LEARN_NAMES``; one pass, counts are combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [p for t in batch.column(0).to_pylist() if t for p in named_people(t)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in pairs], pa.string()), pa.array([f for _, f in pairs], pa.string())], ["given", "family"])

    pairs = df.select(content).where(F.col(content).isNotNull()).mapInArrow(run, "given string, family string")
    counts = pairs.groupBy("given", "family").agg(F.count("*").alias("n")).groupBy("given").agg(F.sum("n").alias("n"), F.count("*").alias("families"))
    kept = counts.where((F.col("n") >= LEARN_TEXTS) & (F.col("families") >= LEARN_FAMILIES) & (F.length("given") > 2))
    return tuple(sorted(r.given for r in kept.orderBy(F.desc("n"), "given").limit(LEARN_NAMES).collect()))


def spans(text: str, automaton=None) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind) of the personal items of a text, in order; ``automaton`` is that of ``anchors``."""
    low = _low(text)
    found: list[tuple[int, int, str]] = []
    for last, kinds in (automaton or anchors()).iter(low):
        for kind, word in kinds:
            at = last - len(word) + 1
            hit = None
            if kind == "email":
                hit = _email(text, at, word)
                kind = "email"
            elif kind == "id":
                if not (at and low[at - 1].isalnum() and word in ("ssn", "dni")):
                    _ids(text, low, at, word, found)
                continue
            elif kind in ("en", "de", "es"):
                hit = _street(text, low, at, word, kind)
                kind = "street_address"
            elif kind == "given":
                hit = _name(text, low, at, word)
                kind = "name"
            elif kind == "frame":
                hit = _framed(text, low, at, word)
                kind = "name"
            else:
                m = _FULL.match(text, last + 1)
                if m and m[1][0].isupper() and m[2][0].isupper() and not {m[1].lower(), m[2].lower()} & NOT_SURNAMES:
                    hit = (m.start(1), m.end())
                kind = "name"
            if hit:
                found.append((*hit, kind))
    if _DIGIT.search(text):
        for m in _SSN.finditer(text):
            found.append((m.start(), m.end(), "id_number"))
        _phones(text, found)
    if len(found) < 2:
        return found
    kept: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda x: (KINDS.index(x[2]), x[0] - x[1], x[0])):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def redact(text: str | None, automaton=None) -> tuple[str | None, list[str]]:
    """The text with typed placeholders, and the kinds it held."""
    if not text:
        return text, []
    found = spans(text, automaton)
    if not found:
        return text, []
    parts, at = [], 0
    for start, end, kind in found:
        parts += [text[at:start], PLACEHOLDER[kind]]
        at = end
    return "".join([*parts, text[at:]]), sorted({k for _, _, k in found})


def found(df: DataFrame, content: str = "content", row_id: str = "row_id", names: tuple[str, ...] | None = None) -> DataFrame:
    """(row_id, kind): one row per kind that a text holds. One pass to learn names unless they are given, one to find."""
    shared = df.sparkSession.sparkContext.broadcast(learned(df, content) if names is None else names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = anchors(shared.value)
        for batch in batches:
            index, kinds = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    for kind in {k for _, _, k in spans(text, known)}:
                        index.append(i)
                        kinds.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array(kinds, pa.string())], [row_id, "kind"])

    return df.select(row_id, content).mapInArrow(run, f"`{row_id}` {dict(df.dtypes)[row_id]}, kind string")


def redacted(df: DataFrame, content: str = "content", row_id: str = "row_id", names: tuple[str, ...] | None = None) -> DataFrame:
    """(row_id, content, kinds): every row with its text redacted."""
    shared = df.sparkSession.sparkContext.broadcast(learned(df, content) if names is None else names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = anchors(shared.value)
        for batch in batches:
            done = [redact(t, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.field("element", pa.string())))],
                [row_id, "content", "kinds"],
            )

    return df.select(row_id, content).mapInArrow(run, f"`{row_id}` {dict(df.dtypes)[row_id]}, content string, kinds array<string>")


def redact_files(spark, source: str, target: str, pattern: str = "*.txt") -> DataFrame:
    """Files below ``source`` written redacted as parquet (path, content, kinds) to ``target``; how many texts held each kind.

    Files are read whole by the executors; a file is one text.
    """
    files = spark.read.text(source, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    redacted(files, "content", "path").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("texts"))
