"""Rules on subtitle texts before and after translation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesheet.functions.text import WS, let, squeeze, strip

# Texts known to be transcription noise.
NOISE = ["i'm honey", "im honey"]
# Filler words.
FILLERS = [
    "ah", "eh", "er", "ha", "hm", "hmm", "huh", "la", "nah", "oh", "ooh", "uh", "uhh", "um", "umm", "whoa", "woo", "wow", "yeah", "yo",
]
# Words that mark a bracketed sound effect.
EFFECTS = (
    "sound|sfx|music|applause|laugh|laughter|gift|tts|cheer|alert|donation|sub|resub|音效|音乐|掌声|笑声|礼物|打赏|提示"
)
# Traces a text model leaves in its replies.
ARTIFACTS = [
    r"<\s*/?\s*tool[_-]?call\b", r"\bDisclaimer\s*:", r"\btranslation exercise\b", r"\bresponse provided\b", r"\bReturn JSON\b",
    r'"translations"\s*:', "```",
]
# Fixed value: a text that is one bracketed remark with such a word in it.
BRACKETED = rf"^{WS}*[\[(（【{{<][^\]\)）】}}>]{{1,64}}(?:{EFFECTS})[^\]\)）】}}>]*[\]\)）】}}>]{WS}*$"
# Fixed value: a short run of capitals, digits and signs.
SHORT_CODE = r"^[A-Z0-9_#@./\\\-]{1,14}[.!?。！]*$"


def _short(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def is_chant(t: Column) -> Column:
    n, unique, half = F.size(t), F.size(F.array_distinct(t)), F.floor(F.size(t) / 2).cast("int")
    halves = (half >= 2) & (F.slice(t, 1, half) == F.slice(t, half + 1, half))
    return (n >= 4) & ((unique <= 2) | ((unique <= 3) & (n >= 6)) | halves)


def is_filler(t: Column) -> Column:
    words = F.array(*[F.lit(w) for w in FILLERS])
    return F.size(t).between(1, 12) & F.forall(t, lambda w: F.array_contains(words, w))


def _by_words(t: Column) -> Column:
    return F.when(is_chant(t), "repeated_chant").when(is_filler(t), "filler_noise")


def skip_reason(text: Column) -> Column:
    """Why a text is not worth translating; null when it is.  The first rule wins."""
    marks = r"[.!?。！？]+"

    def judge(s: Column) -> Column:
        normal = squeeze(F.regexp_replace(F.lower(s), rf"^{marks}|{marks}\z", ""))
        return (
            F.when(F.length(s) == 0, "empty")
            .when(normal.isin(NOISE), "known_transcript_noise")
            .when(s.rlike(f"(?iu){BRACKETED}"), "bracketed_effect")
            .when(F.length(s) <= 2, "too_short")
            .when(s.rlike(SHORT_CODE) & ~s.rlike("(?i)[aeiou]{2,}"), "short_code_or_noise")
            .otherwise(let(tokens(s), _by_words))
        )

    return let(strip(_short(text)), judge)


def has_artifact(c: Column) -> Column:
    return c.rlike("(?iU)" + "|".join(ARTIFACTS))


def is_json_fragment(c: Column) -> Column:
    s = strip(c)
    return (F.length(s) >= 2) & s.rlike(r"^[{\[]") & (~s.rlike(r"[。！？.!?)\]}】）]\z") | s.rlike(r'(?U)"\w+"\s*:'))


def is_suspicious(source: Column, translation: Column) -> Column:
    """Far longer than its source."""
    s, t = F.length(strip(_short(source))), F.length(strip(_short(translation)))
    return (s > 0) & (t > 0) & (t > F.greatest(F.lit(180), s * 4))


def clean_translation(text: Column, fallback: Column) -> Column:
    """The stripped translation, or the stripped source when the reply is unusable."""
    t, f = strip(_short(text)), strip(_short(fallback))
    bad = (F.length(t) == 0) | has_artifact(t) | is_json_fragment(t) | is_suspicious(f, t)
    return F.when(bad, f).otherwise(t)
