"""Scalar text functions as column expressions; null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column) -> Column:
    """Runs of other characters than letters, digits, dot, underscore and dash become one underscore."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def short_slug(text: Column, words: int = 4, most: int = 48) -> Column:
    """Letters and digits of the first words, lower case, joined by dashes; ``untitled`` where there are none."""
    chosen = F.slice(F.split(stripped(text), r"(?U)\s+"), 1, max(1, words))
    bare = F.filter(F.transform(chosen, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))), lambda w: w != "")
    slug = F.when(F.size(bare) > 0, F.array_join(bare, "-")).otherwise("untitled")
    return F.when(text.isNotNull(), F.regexp_replace(F.substring(slug, 1, most), "-+$", ""))


def _escaped(text: Column) -> Column:
    """Percent-encoded but for letters, digits and ``-_.~``."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def params_text(params: Column) -> Column:
    """``key=value`` pairs of a map<string,string>, by key, joined by ``&``; null values are ``None``."""
    pairs = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(_escaped(e["value"]), F.lit("None")))), "&")


def params_of(text: Column) -> Column:
    """map<string,string> of such a text; ``None`` becomes null."""
    pairs = F.filter(F.split(text, "&"), lambda x: x != "")
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.url_decode(F.substr(x, F.instr(x, F.lit("=")) + 1)).alias("v")))
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"].alias("k"), F.nullif(e["v"], F.lit("None")).alias("v"))))


def _folded(text: Column) -> Column:
    """Lower case with sharp s as ss, so that both cases of a word agree."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_quote(text: Column) -> Column:
    """White space collapsed, letter case folded, trimmed."""
    return F.trim(_folded(F.regexp_replace(text, r"(?U)\s+", " ")))


def tokens(text: Column) -> Column:
    """Quote words: ASCII letters, digits and apostrophes, lower case."""
    return F.regexp_extract_all(_folded(text), F.lit(r"([a-z0-9']+)"), 1)


def tokens_in(tokens_: Column, candidate: Column) -> Column:
    """Whether the candidate's tokens stand in a row."""
    pad = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return (F.size(candidate) > 0) & F.contains(pad(tokens_), pad(candidate))


def quote_found(quote: Column, content: Column) -> Column:
    """Quote as substring, as normalised substring, or as a run of tokens."""
    return (
        F.contains(_folded(content), _folded(stripped(quote)))
        | F.contains(normalize_quote(content), normalize_quote(quote))
        | tokens_in(tokens(content), tokens(quote))
    )


def unmatched_quotes(matches: Column, content: Column) -> Column:
    """Quotes that do not stand in the content; blank ones are dropped."""
    return F.filter(matches, lambda m: (F.trim(m) != "") & ~quote_found(m, content))


def matched_quotes(matches: Column, content: Column) -> Column:
    """Quotes that stand in the content."""
    return F.filter(matches, lambda m: (F.trim(m) != "") & quote_found(m, content))


#: Fixed value: how an error about quotes begins.
QUOTE_ERROR = "Quoted text not found in transcript"


def quotes_of_error(error: Column) -> Column:
    """Double-quoted strings after ``QUOTE_ERROR``, none without it (F16)."""
    after = F.substr(error, F.instr(error, F.lit(QUOTE_ERROR)) + len(QUOTE_ERROR))
    return F.when(F.contains(error, F.lit(QUOTE_ERROR)), F.regexp_extract_all(after, F.lit('"([^"]*)"'), 1)).when(error.isNotNull(), F.array().cast("array<string>"))


def without_thought(text: Column, tag: str = "think") -> Column:
    """struct<thought, answer>: the first tagged part, null if blank, and the text around it."""
    pattern = rf"(?s)^(.*?)<{tag}>(.*?)</{tag}>(.*)$"
    has = text.rlike(pattern)
    whole = F.coalesce(text, F.lit(""))
    return F.struct(
        F.when(has, F.nullif(stripped(F.regexp_extract(text, pattern, 2)), F.lit(""))).alias("thought"),
        stripped(F.when(has, F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 3))).otherwise(whole)).alias("answer"),
    )


def _object(answer: Column) -> Column:
    """The JSON object of an answer, code fences, words around it and commas before a bracket taken off."""
    return F.regexp_replace(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), r",\s*([}\]])", "$1")


def _score(value: Column) -> Column:
    """Half-even integer, 0 to 10."""
    return F.least(F.lit(10), F.greatest(F.lit(0), F.bround(value).cast("int")))


def response(text: Column) -> Column:
    """struct<thought, score, matches, error> of a model's JSON answer.

    An answer is an object with ``quotes`` (a list; blank ones are dropped) and a numeric ``score``, or the
    empty object, which has neither score nor error. Everything else has an ``error``.
    """
    split = without_thought(text)
    body = _object(split["answer"])
    parsed = F.from_json(body, "score double, quotes array<string>")
    empty = body.rlike(r"^\{\s*\}$")
    whole = F.from_json(body, "map<string,string>").isNotNull()
    quotes = F.filter(F.transform(parsed["quotes"], stripped), lambda q: q != "")
    error = (
        F.when(F.coalesce(body, F.lit("")) == "", "no object").when(empty, None).when(~whole, "malformed object")
        .when(F.get_json_object(body, "$.quotes").isNull() | F.get_json_object(body, "$.score").isNull(), "field missing")
        .when(parsed["quotes"].isNull(), "quotes are no list").when(parsed["score"].isNull(), "score is no number")
    )
    return F.struct(
        split["thought"].alias("thought"), F.when(error.isNull() & ~empty, _score(parsed["score"])).alias("score"),
        F.when(error.isNull() & ~empty, quotes).otherwise(F.array().cast("array<string>")).alias("matches"), error.alias("error"),
    )


#: The three scores of a subset.
SUBSET_SCORES = ("prior_conversation_reliance", "uploaded_document_reliance", "cohesion")


def subset_response(text: Column) -> Column:
    """struct of the three scores of a subset, notes, thought and error (F43); one score missing is an error."""
    split = without_thought(text)
    body = _object(split["answer"])
    parsed = F.from_json(body, ", ".join(f"{k} double" for k in SUBSET_SCORES) + ", notes string")
    bad = F.coalesce(body, F.lit("")) == ""
    for k in SUBSET_SCORES:
        bad = bad | parsed[k].isNull()
    bad = F.coalesce(bad, F.lit(True))
    return F.struct(
        split["thought"].alias("thought"), *[F.when(~bad, _score(parsed[k])).alias(k) for k in SUBSET_SCORES],
        F.when(~bad, F.nullif(stripped(parsed["notes"]), F.lit(""))).alias("notes"), F.when(bad, "three numbers needed").alias("error"),
    )


def normalize_text(text: Column) -> Column:
    """Form feeds to two newlines, carriage returns to one, at most one empty line in a row, trimmed."""
    lines = F.regexp_replace(F.replace(text, F.lit("\f"), F.lit("\n\n")), r"\r\n?", "\n")
    return stripped(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def fix_cids(text: Column) -> Column:
    """Codes of extracted PDF text (F21): 431 is ``ff``; other codes go unless they stand inside a word."""
    return F.regexp_replace(F.replace(text, F.lit("(cid:431)"), F.lit("ff")), r"(?U)(^|\W)\(cid:\d+\)(\W|$)", "$1$2")


def interface_of(text: Column) -> Column:
    """Which chat interface an export text came from, by the marks of its layout (F23); null for null."""
    low = F.lower(text)
    # Marks of the exports.
    has = lambda *patterns: [low.rlike("(?mU)" + p) for p in patterns]
    both = lambda *patterns: has(patterns[0])[0] & has(patterns[1])[0]
    chatgpt = both(r"\bchat history\b", "chatgpt said:") | has(r"\bchatgpt (can make mistakes|says:)")[0] | both(r"^#####\s+\*\*you said:\*\*", r"######\s+\*\*chatgpt said:\*\*")
    claude = both(r"^\s*(human|user)\s*:\s", r"^\s*(assistant|claude)\s*:\s") | both(r"^###\s*(human|user)\b", r"^###\s*(assistant|claude)\b")
    gemini = both(r"^\s*#{1,6}\s*(you|me)\b.*\n", r"^\s*#{1,6}\s*(gemini|assistant)\b.*\n") | has(r"\b(gemini says:|model:\s*gemini)\b")[0]
    return F.when(chatgpt, "chatgpt").when(claude, "claude").when(gemini, "gemini").when(text.isNotNull(), "unknown")


def age_bin(age: Column) -> Column:
    """Five age groups, null for no age."""
    return F.when(age < 18, "under-18").when(age < 30, "18-29").when(age < 40, "30-39").when(age < 50, "40-49").when(age.isNotNull(), "50+")


def round3(value: Column) -> Column:
    """Three decimals by the double's exact value, ties to even."""
    return F.call_function("format_number", value, F.lit("0.000")).cast("double")


def short_label(label: Column) -> Column:
    """Annotation ids as short axis labels."""
    # Renamed ids and words.
    out = F.when(label == "grand-significance", "bot-grand-significance").otherwise(label)
    out = F.replace(F.replace(out, F.lit("intent"), F.lit("thoughts")), F.lit("validates"), F.lit("acks"))
    out = F.regexp_replace(out, "^(?:assistant|chatbot)-", "bot-")
    return F.when(F.contains(label, F.lit("theme-awakening-consciousness")), "bot-delusion-themes").otherwise(out)


def opacity(spread: Column, centre: float = 0.15, scale: float = 0.05) -> Column:
    """Opacity of an estimate by its posterior spread, a logistic between 0.1 and 1; 1 where there is none."""
    x = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), (centre - spread) / scale))
    return F.when(spread <= 0, 1.0).when(spread.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.1), 1 / (1 + F.exp(-x)))))


def encode_id(*parts: Column) -> Column:
    """Percent-encoded parts joined by a bar."""
    return F.concat_ws("|", *[_escaped(p.cast("string")) for p in parts])


def decode_id(text: Column, n: int = 5, numbers: tuple[int, ...] = ()) -> Column:
    """The parts of an encoded id, null unless there are n and those at ``numbers`` are integers."""
    parts = F.split(text, r"\|")
    fine = F.size(parts) == n
    for k in numbers:
        fine = fine & F.coalesce(F.get(parts, k).rlike(r"^[+-]?\d+$"), F.lit(False))
    return F.when(fine, F.transform(parts, lambda p: F.url_decode(p)))


def display_participant(p: Column) -> Column:
    """Study prefixes as numbers."""
    return F.regexp_replace(F.regexp_replace(p, "^irb_", "1-"), "^hl_", "2-")


def bucket(path: Column) -> Column:
    """Nearest folder of the form letters, underscore, digits."""
    return F.nullif(F.lower(F.regexp_extract(path, r"(?i)(?:^|.*/)([a-z]+_[0-9]{2,})/", 1)), F.lit(""))


def conversation_text(messages: Column) -> Column:
    """Numbered lines ``01. Role: text`` of array<struct<role, content>>, an empty line between them."""
    word = lambda m: F.lower(F.trim(m["role"]))
    label = lambda m: F.when(word(m) == "user", "User").when(word(m) == "assistant", "Assistant").otherwise(F.coalesce(F.nullif(m["role"], F.lit("")), F.lit("unknown")))
    number = lambda i: F.when(i < 9, F.concat(F.lit("0"), (i + 1).cast("string"))).otherwise((i + 1).cast("string"))
    return F.array_join(F.transform(messages, lambda m, i: F.concat(number(i), F.lit(". "), label(m), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n\n")


def word_count(text: Column) -> Column:
    """White-space separated words; 0 for blank and null."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def title_of(title: Column, path: Column, meta: Column | None = None) -> Column:
    """The title, or the stem of the file named in the metadata, or the path's stem."""
    stem = lambda p: F.regexp_extract(p, r"([^/]+?)(?:\.[^./]*)?/*$", 1)
    named = F.lit(None).cast("string") if meta is None else F.when(F.trim(meta) != "", stem(meta))
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), named, stem(path))


def date_label(label: Column) -> Column:
    """A label as instant: epoch seconds, two forms that end in UTC, ISO 8601, a bare minute or day, all in UTC.

    Anything else, blank and null give null. Runs with the session in UTC, as all of this package.
    """
    text = stripped(label)
    number = text.rlike(r"^(\d+\.?\d*|\.\d+)$") & (text.try_cast("double") < 253402300800)  # up to the year 9999
    bare = F.regexp_replace(text, " UTC$", "")
    utc = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}(:\d{1,2})? UTC$") | text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{1,2})?$")
    forms = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in ("y-M-d H:m:s", "y-M-d H:m", "y-M-d")])
    zone = r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?"
    iso = text.rlike(rf"^\d{{4}}-?\d{{2}}-?\d{{2}}(?:.\d{{2}}(?::?\d{{2}}(?::?\d{{2}}(?:[.,]\d+)?)?)?{zone})?$")
    # One spelling of ISO 8601: separators in, six digits of a fraction, an offset with a colon.
    day = F.regexp_replace(text, r"^(\d{4})-?(\d{2})-?(\d{2})", "$1-$2-$3")
    clock = F.regexp_replace(F.regexp_replace(day, r"^(\d{4}-\d{2}-\d{2}).(\d{2})", "$1T$2"), r"(T\d{2}):?(\d{2}):?(\d{2})", "$1:$2:$3")
    full = F.regexp_replace(F.regexp_replace(clock, r"(T\d{2})(?=$|Z|[+-])", "$1:00"), r"(\d{2}:\d{2}:\d{2})[.,](\d{1,6})\d*", "$1.$2")
    full = F.regexp_replace(F.regexp_replace(full, r"([+-]\d{2})$", "$1:00"), r"(T.*[+-]\d{2})(\d{2})$", "$1:$2")
    return (
        F.when(number, F.timestamp_micros(F.round(text.try_cast("double") * 1_000_000).cast("bigint")))
        .when(utc, forms).when(iso, full.try_cast("timestamp"))
    )


def timestamp_label(value: Column) -> Column:
    """A stated value as label: trimmed text, null for blank and for numbers that are not above 0."""
    text = stripped(value.cast("string"))
    return F.when((text != "") & ~F.coalesce(text.try_cast("double") <= 0, F.lit(False)), text)


#: Names of a time in a message's metadata.
TIME_KEYS = ("date", "timestamp", "created_at", "create_time", "updated_at", "update_time")


def contact_terms(cell: Column) -> Column:
    """Distinct identifiers of a contact cell: addresses, phrases with two letters or more, their words."""
    parts = F.filter(F.transform(F.split(cell, r"[;,\n]+"), stripped), lambda p: p != "")
    worded = F.filter(parts, lambda p: F.regexp_count(p, F.lit(r"[A-Za-z\u00C0-\u024F]")) >= 2)
    mails = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), 1)))
    return F.array_sort(F.array_distinct(F.concat(mails, worded, F.flatten(F.transform(worded, lambda p: F.split(p, r"(?U)\s+"))))))


def prompt(template: str, **fields: Column) -> Column:
    """A template with ``{name}`` fields filled (X15); null fields are empty."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def pseudonym(kind: str, text: Column, size: int = 8) -> Column:
    """Stable replacement of an entity (X11)."""
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat_ws("|", F.lit(kind), F.lower(text)), 256), 1, size))


def latex_escaped(text: Column) -> Column:
    """Characters that LaTeX reads as commands, escaped."""
    # Characters and what stands for them; the backslash goes first, by way of a mark of its own.
    out = F.replace(text, F.lit("\\"), F.lit("\u0001"))
    for c in "&%$#_{}":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    for c, named in (("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"), ("\u0001", r"\textbackslash{}")):
        out = F.replace(out, F.lit(c), F.lit(named))
    return out


def page_link(path: Column, chat_index: Column) -> Column:
    """Percent-encoded path of a conversation's page and its place there."""
    page = F.regexp_replace(path, r"\.json$", ".html")
    return F.concat(F.replace(_escaped(page), F.lit("%2F"), F.lit("/")), F.lit("#chat-"), (chat_index + 1).cast("string"))


def anonymised(text: Column, spans: Column, how: str = "replace") -> Column:
    """The text with array<struct<start, stop, kind>> spans (code points, in order, apart from each other) put away.

    ``how``: replace (kind in brackets), mask (as many asterisks), hash (digest), redact (nothing), fake (a stable pseudonym).
    Null text stays null; without spans nothing changes.
    """
    part = lambda s: F.substr(text, s["start"] + 1, s["stop"] - s["start"])
    put = {
        "replace": lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">")), "mask": lambda s: F.repeat(F.lit("*"), s["stop"] - s["start"]),
        "hash": lambda s: F.sha2(part(s), 256), "redact": lambda s: F.lit(""), "fake": lambda s: F.concat(s["kind"], F.lit("_"), F.substring(F.sha2(F.concat_ws("|", s["kind"], F.lower(part(s))), 256), 1, 8)),
    }[how]
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["done"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), put(s)).alias("done"), s["stop"].alias("at"))
    return F.aggregate(F.coalesce(spans, F.array().cast("array<struct<start:int,stop:int,kind:string>>")), start, step, lambda acc: F.concat(acc["done"], F.substr(text, acc["at"] + 1, F.length(text))))
