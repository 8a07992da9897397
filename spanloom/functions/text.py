"""Text functions on columns: counts, normal forms, predicates, cuts. All are built-in expressions, so they stay
in generated code. A null text counts as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}_]"
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"
#: Besides CJK characters, marks that take no space after them, and marks that take none before them.
NO_SPACE_AFTER = CJK[:-1] + r"，。！？；：、（）「」『』【】《》(\[{]"
NO_SPACE_BEFORE = CJK[:-1] + r"，。！？；：、）」』】》,.!?;:)\]}%]"

#: Words that open a sentence without meaning anything.
FILLERS = ("那麼", "那", "其實", "然後", "而且", "好", "來", "對", "就是", "所以", "OK", "ok", "現在", "另外")
#: Marks that close a sentence, and marks that close a clause.
CLOSURE = ("。", "！", "？", "!", "?", "……", "...")
CLAUSE = ("，", ",", "、", "；", ";", "：", ":")
#: What a line of metadata in a script begins with, and labels before spoken text.
METADATA = (
    "標題：", "標題:", "主題：", "主題:", "大綱：", "大綱:", "備註：", "備註:", "說明：", "說明:", "專案：", "專案:",
    "title:", "subject:", "topic:", "outline:", "author:", "date:", "duration:", "scene:", "note:", "notes:",
)
LABELS = (
    "內文：", "內文:", "講稿：", "講稿:", "腳本：", "腳本:", "台詞：", "台詞:", "旁白：", "旁白:", "口白：", "口白:",
    "body:", "script:", "narration:", "voiceover:", "vo:",
)
CUES = r"（.*?）|\(.*?\)|【.*?】|\[.*?\]"
#: File suffix and media type.
MEDIA_TYPES = {
    ".mp4": "video/mp4", ".mov": "video/quicktime", ".mkv": "video/x-matroska", ".avi": "video/x-msvideo", ".webm": "video/webm",
    ".flv": "video/x-flv", ".wmv": "video/x-ms-wmv", ".m4v": "video/mp4", ".mp3": "audio/mpeg", ".wav": "audio/wav",
    ".m4a": "audio/mp4", ".aac": "audio/aac", ".flac": "audio/flac", ".ogg": "audio/ogg", ".opus": "audio/opus",
}


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def norm(c: Column) -> Column:
    """Letters, digits and _ only, in lower case."""
    return F.lower(F.regexp_replace(text_of(c), NOT_WORD, ""))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(text_of(c), F.lit(pattern)).cast("long")


def cjk_chars(c: Column) -> Column:
    return count_of(c, CJK)


def latin_chars(c: Column) -> Column:
    return count_of(c, "[A-Za-z]")


def latin_words(c: Column) -> Column:
    return count_of(c, "[A-Za-z]+")


def display_width(c: Column) -> Column:
    """Half-width units: 2 for each character beyond ASCII, else 1."""
    return F.length(text_of(c)).cast("long") + count_of(c, r"[^\x00-\x7F]")


def strip_fillers(c: Column, fillers=FILLERS) -> Column:
    """The normal form without filler words at the start, however many follow each other with commas or spaces between."""
    words = "|".join(sorted(fillers, key=lambda w: (-len(w), w)))
    return norm(F.regexp_replace(text_of(c), rf"^{NOT_WORD}*(?:(?:{words})[，,、 \x{{3000}}]*)+", ""))


def is_viable(c: Column, seconds: Column | None = None) -> Column:
    """Whether a piece of speech can stand alone: long enough in characters or words and, if given, in time."""
    cjk, chars, words = cjk_chars(c), count_of(c, "[A-Za-z0-9]"), count_of(c, "[A-Za-z0-9]+")
    enough = (cjk >= 4) | (words >= 3) | (chars >= 10) | ((cjk >= 2) & (chars >= 3))
    lasts = F.lit(True) if seconds is None else F.coalesce(seconds >= 0.55, F.lit(True))
    return (F.length(norm(c)) >= 2) & lasts & enough


def ends_with_any(c: Column, marks) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.endswith(F.rtrim(text_of(c)), F.lit(m))
    return out


def join_for_display(words: Column) -> Column:
    """Words with spaces between them, but none beside CJK characters, after opening or before closing marks."""
    return F.regexp_replace(F.regexp_replace(F.array_join(words, " "), rf"({NO_SPACE_AFTER}) ", "$1"), rf" ({NO_SPACE_BEFORE})", "$1")


def offset_seconds(c: Column) -> Column:
    """Text such as 12.345s as seconds; 0 for null or anything else."""
    return F.coalesce(F.regexp_extract(c, r"^([0-9]+(?:\.[0-9]+)?)s$", 1).try_cast("double"), F.lit(0.0))


def locale_hint(c: Column) -> Column:
    """The locale that a text's script suggests."""
    t = text_of(c)
    return (
        F.when(t.rlike(r"[\x{3040}-\x{30FF}]"), "ja").when(t.rlike(r"[\x{AC00}-\x{D7AF}]"), "ko")
        .when(t.rlike(r"[\x{4E00}-\x{9FFF}]"), "zh-TW").when(count_of(c, "[A-Za-z]{2,}") >= 5, "en").otherwise("zh-TW")
    )


def media_type(path: Column, default: str = "video/mp4") -> Column:
    suffix = F.lower(F.regexp_extract(text_of(path), r"\.[^.]+$", 0))
    pairs = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, suffix), F.lit(default))


def drive_id(c: Column) -> Column:
    """The id in a share link or a bare id of 15 characters or more; null if there is none. The first form wins."""
    forms = (r"^gdrive://([A-Za-z0-9_-]+)", r"/folders/([A-Za-z0-9_-]+)", r"/file/d/([A-Za-z0-9_-]+)", r"[?&]id=([A-Za-z0-9_-]+)", r"^([A-Za-z0-9_-]{15,})$")
    return F.coalesce(*(F.nullif(F.regexp_extract(text_of(c), f, 1), F.lit("")) for f in forms))


def escape_attr(c: Column) -> Column:
    out = text_of(c)
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(ref))
    return out


def attachment_name(header: Column, fallback: Column) -> Column:
    """The file name in a Content-Disposition header: extended, quoted or plain form."""
    part = lambda p: F.nullif(F.regexp_extract(text_of(header), p, 1), F.lit(""))
    extended = F.try_url_decode(part(r"filename\*=[Uu][Tt][Ff]-8''([^;]+)"))
    return F.coalesce(extended, part(r'filename="([^"]+)"'), F.trim(part(r"filename=([^;]+)")), fallback)


def norm_head(c: Column, n: int) -> Column:
    """The start of a text up to its n-th word character; the whole text if it has fewer."""
    cut = F.regexp_extract(text_of(c), rf"^((?:{NOT_WORD}*[\p{{L}}\p{{N}}_]){{{n}}})", 1)
    return F.when(F.length(norm(c)) >= n, cut).otherwise(text_of(c))


def norm_cut(c: Column, n: Column) -> Column:
    """The start of a text before its word character number n (from 0); the whole text if it has no more."""
    pattern = F.concat(F.lit(rf"^((?:{NOT_WORD}*+[\p{{L}}\p{{N}}_]){{"), n.cast("string"), F.lit(rf"}}+{NOT_WORD}*+)"))
    return F.when(F.length(norm(c)) > n, F.call_function("regexp_extract", text_of(c), pattern, F.lit(1))).otherwise(text_of(c))


def phrase_count(text: Column, phrase: Column) -> Column:
    """Occurrences of phrase in text that do not overlap; 0 for an empty phrase."""
    n = F.length(phrase)
    gone = F.length(text) - F.length(F.replace(text, phrase, F.lit("")))
    return F.when(n > 0, (gone / n).cast("long")).otherwise(F.lit(0).cast("long"))


def suffix_prefix(a: Column, b: Column, most: int = 48, least: int = 5) -> Column:
    """Length of the longest end of a that begins b, from most down to least characters; 0 if none."""
    ends = F.array(F.struct(F.right(a, F.lit(most)).alias("a"), F.left(b, F.lit(most)).alias("b")))  # bound once, not once a length
    longest = lambda x: F.get(F.filter(F.sequence(F.lit(most), F.lit(least), F.lit(-1)), lambda k: (F.length(x["a"]) >= k) & (F.right(x["a"], k) == F.left(x["b"], k))), F.lit(0))
    return F.coalesce(F.get(F.transform(ends, longest), F.lit(0)), F.lit(0)).cast("long")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def script_blocks(text: Column) -> Column:
    """The spoken blocks of a script, array<struct<raw,norm>>: its lines without front matter (all of it if it is never
    closed), headings, rules, lines of metadata, and marks of lists and quotes and section labels at their start. norm is
    without cues in brackets; blocks with under four word characters are none."""
    one = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # c is worked out once, not wherever f has it
    cut = lambda l, close: F.when(close > 0, F.slice(l, close + 1, F.size(l))).otherwise(F.array().cast("array<string>"))
    closes = lambda l: F.array_position(F.transform(l, lambda x, i: (i > 0) & x.isin("---", "...")), F.lit(True)).cast("int")
    bodies = lambda l: F.when(F.get(l, F.lit(0)) != "---", l).otherwise(one(closes(l), lambda close: cut(l, close)))
    body = one(F.transform(F.split(text_of(text), "\n"), strip), bodies)
    some = F.filter(body, lambda x: ~x.rlike(r"^(?:#|[-=*_]{3,}$)"))
    bare = F.transform(some, lambda x: strip(F.regexp_replace(x, r"^[>*\-\p{Nd}.]+", "")))
    spoken = F.filter(bare, lambda x: ~F.lower(x).rlike(f"^(?:{'|'.join(METADATA)})"))
    raw = F.transform(spoken, lambda x: strip(F.regexp_replace(x, f"(?i)^(?:{'|'.join(LABELS)})", "")))
    both = F.transform(raw, lambda x: F.struct(x.alias("raw"), norm(F.regexp_replace(x, CUES, "")).alias("norm")))
    return F.filter(both, lambda x: F.length(x["norm"]) >= 4)


def lenient_json(c: Column) -> Column:
    """The JSON text inside fences, words around it, or without the outer brackets of a list."""
    t = F.trim(text_of(c))
    fenced = F.nullif(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))
    t = F.coalesce(fenced, t)
    return F.when(t.rlike(r"(?s)^\{.*\}\s*,\s*\{.*\}$"), F.concat(F.lit("["), t, F.lit("]"))).otherwise(F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)(\[.*\]|\{.*\})", 1), F.lit("")), t))


def frame_rate(fps: Column) -> Column:
    """struct(num, den, tag): a frame lasts num/den seconds; rates off a whole number are the 1001 family."""
    base = F.bround(fps).cast("long")
    odd = F.abs(fps - F.bround(fps)) > 0.001
    tag = F.when(odd & (base == 24), "2398").when(odd & (base == 30), "2997").when(odd & (base == 60), "5994").otherwise(F.concat(base.cast("string"), F.lit("p")))
    return F.struct(F.when(odd, 1001).otherwise(100).cast("long").alias("num"), F.when(odd, F.greatest(F.lit(1000), base * 1000)).otherwise(F.greatest(F.lit(100), base * 100)).cast("long").alias("den"), tag.alias("tag"))
