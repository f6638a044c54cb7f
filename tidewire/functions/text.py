"""Text functions over columns: cleaning, folding, stemming, headline terms and entities. All JVM-side."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column, functions as F

# Words that never link two headlines, English ones, those of the trade, German, French, and Spanish, Portuguese and Italian ones.
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has",
    "have", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just",
    "me", "more", "most", "my", "myself", "new", "news", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours",
    "ourselves", "out", "over", "own", "s", "same", "she", "should", "so", "some", "such", "t", "than", "that", "the", "their", "theirs", "them", "themselves",
    "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where",
    "which", "while", "who", "whom", "why", "will", "with", "you", "your", "yours", "yourself", "yourselves",
    "say", "says", "said", "live", "video", "watch", "breaking", "latest", "update", "updates", "exclusive", "opinion", "analysis", "photos", "podcast", "amp",
    "der", "das", "und", "ist", "im", "mit", "von", "zu", "den", "dem", "des", "ein", "eine", "einer", "eines", "auf", "fur", "nicht", "sich", "bei", "nach",
    "aus", "als", "auch", "es", "wie", "wird", "werden", "hat", "sind", "vom", "zum", "zur", "um", "uber", "noch", "jetzt",
    "le", "la", "les", "un", "une", "du", "de", "et", "en", "au", "aux", "pour", "par", "sur", "dans", "est", "qui", "que", "pas", "avec", "ce", "cette", "se",
    "ses", "il", "elle", "ils", "apres", "sont", "selon",
    "el", "los", "las", "del", "al", "por", "con", "para", "una", "uno", "su", "sus", "como", "mas", "lo", "tras", "os", "uma", "da", "dos", "na", "nos", "nas",
    "em", "ao", "gli", "della", "delle", "dei", "di", "per", "che", "nel", "nella", "sobre", "entre",
)


_HANGUL = range(0xAC00, 0xD7A4)


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Letters that lose their marks one for one, and those that unfold into several, by Unicode's own rule."""
    one, to, many = [], [], {}
    for code in [*range(0xA0, 0xAC00), *range(0xF900, 0x10000)]:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))
        if plain == c or not c.isalnum():
            continue
        if len(plain) == 1:
            one.append(c)
            to.append(plain)
        elif plain:
            many[c] = plain
    return "".join(one), "".join(to), many


def _composed_pairs() -> dict[str, str]:
    """Letter and mark that are written as one letter when composed, by Unicode's own rule."""
    out = {}
    for code in range(0xC0, 0x10000):
        pair = unicodedata.normalize("NFD", chr(code)) if code not in _HANGUL and not 0xD800 <= code < 0xE000 else ""
        for cut in range(1, len(pair)):
            left, right = unicodedata.normalize("NFC", pair[:cut]), pair[cut:]
            if len(left) == 1 and len(right) == 1 and unicodedata.normalize("NFC", left + right) == chr(code):
                out[left + right] = chr(code)
    return out


_ONE, _TO, _MANY = _fold_tables()
_PAIRS = _composed_pairs()
SPACE = r"[\s   -     　﻿]"


#: Asked first, as most headlines and words need no more than that.
_BEYOND_ASCII = r"[^\x00-\x7F]"


def _literal_map(items: dict[str, str]) -> Column:
    """One literal, that the optimizer turns into a map once."""
    return F.from_json(F.lit(json.dumps(items)), "map<string,string>")


def compose(text: Column) -> Column:
    """Letters and the marks after them as single letters, where there is one; texts without marks stay as they are."""
    known = _literal_map(_PAIRS)
    join = lambda acc, c: F.coalesce(F.try_element_at(known, F.concat(acc, c)), F.concat(acc, c))
    one = lambda cluster: F.when(F.length(cluster) > 1, F.aggregate(F.filter(F.split(cluster, ""), lambda c: c != ""), F.lit(""), join)).otherwise(cluster)
    marked = text.rlike(_BEYOND_ASCII) & text.rlike(r"\p{M}")
    return F.when(marked, F.array_join(F.transform(F.split(text, r"(?=\P{M})"), one), "")).otherwise(text)


def _utf16(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, F.lit("0"))), "UTF-16BE")


def _unfolded(c: Column) -> Column:
    """One character, taken apart: compatibility letters by the table, Hangul syllables into their letters by rule."""
    at = F.ascii(c).cast("long") - _HANGUL.start
    tail = F.when(at % 28 > 0, _utf16(0x11A7 + at % 28)).otherwise(F.lit(""))
    syllable = F.concat(_utf16(0x1100 + F.floor(at / 588)), _utf16(0x1161 + F.floor((at % 588) / 28)), tail)
    return F.when((at >= 0) & (at < len(_HANGUL)), syllable).otherwise(F.coalesce(F.try_element_at(_literal_map(_MANY), c), c))


def fold(text: Column) -> Column:
    """Without accents: compatibility forms unfolded, marks dropped."""
    out = F.translate(text, _ONE, _TO)
    several = F.length(F.translate(out, "".join(_MANY), "")) < F.length(out)
    rare = several | out.rlike("[\uac00-\ud7a3]")
    out = F.when(rare, F.array_join(F.transform(F.split(out, ""), _unfolded), "")).otherwise(out)
    return F.when(text.rlike(_BEYOND_ASCII), F.regexp_replace(out, r"\p{M}+", "")).otherwise(text)


def clean_text(value: Column) -> Column:
    """Without scripts, styles and tags; four entities decoded once; white space collapsed; '' becomes null."""
    out = F.regexp_replace(value, r"(?is)<(?:script|style).*?</(?:script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    out = F.regexp_replace(out, f"{SPACE}+", " ")
    out = F.replace(F.replace(F.replace(out, F.lit("&nbsp;"), F.lit(" ")), F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'"))
    out = F.replace(out, F.lit("&amp;"), F.lit("&"))
    return F.nullif(F.trim(out), F.lit(""))


def stem(token: Column) -> Column:
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when(n <= 3, token)
        .when(token.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(token.endswith("ing") & (n > 5), cut(3))
        .when(token.endswith("ed") & (n > 4), cut(2))
        .when(token.endswith("es") & (n > 4), cut(2))
        .when(token.endswith("s") & (n > 4), cut(1))
        .otherwise(token)
    )


def tokens(headline: Column) -> Column:
    """array<struct<surface, stem>>: words of a headline, with what matching compares."""
    body = F.regexp_replace(F.lower(compose(F.coalesce(headline, F.lit("")))), r"['’]s(?![A-Za-z0-9_])", "")
    words = F.filter(F.split(body, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    keyed = F.transform(words, lambda w: F.named_struct(F.lit("surface"), w, F.lit("key"), fold(w)))
    kept = F.filter(keyed, lambda t: (F.length(t["key"]) > 1) & ~t["key"].isin(*STOPWORDS) & ~t["key"].rlike("^[0-9]+$"))
    stemmed = F.transform(kept, lambda t: F.named_struct(F.lit("surface"), t["surface"], F.lit("stem"), stem(t["key"])))
    return F.filter(stemmed, lambda t: (F.length(t["stem"]) > 1) & ~t["stem"].isin(*STOPWORDS))


def bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def terms(stems: Column) -> Column:
    """Stems followed by adjacent pairs, repeats kept."""
    return F.concat(stems, bigrams(stems))


def surfaces(toks: Column) -> Column:
    """array<struct<term, surface>> in order: single words, then pairs; of repeated terms the last form holds."""
    single = F.transform(toks, lambda t: F.struct(t["stem"].alias("term"), t["surface"].alias("surface")))
    stems, forms = F.transform(toks, lambda t: t["stem"]), F.transform(toks, lambda t: t["surface"])
    pairs = F.zip_with(bigrams(stems), bigrams(forms), lambda a, b: F.struct(a.alias("term"), b.alias("surface")))
    return F.concat(single, pairs)


def entities(headline: Column) -> Column:
    """Up to 12 distinct runs of capitalised words or acronyms, in order."""
    # Word boundaries are ASCII ones, which the engine's own are not.
    pattern = r"(?<![A-Za-z0-9_])(?:[A-Z][a-zA-Z0-9]+|[A-Z]{2,})(?:\s+(?:[A-Z][a-zA-Z0-9]+|[A-Z]{2,})){0,3}(?![A-Za-z0-9_])"
    found = F.transform(F.regexp_extract_all(F.coalesce(headline, F.lit("")), F.lit(pattern), F.lit(0)), lambda e: F.trim(e))
    return F.slice(F.array_distinct(F.filter(found, lambda e: (F.length(e) > 1) & ~F.lower(e).isin(*STOPWORDS))), 1, 12)


def truncate(value: Column, n: int) -> Column:
    """White space collapsed; longer texts end in an ellipsis within n characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), f"{SPACE}+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def clean_description(summary: Column, title: Column, n: int = 300) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(summary, F.lit("")), f"{SPACE}+", " "))
    cut = F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)
    return F.when((flat != "") & (flat != F.trim(F.coalesce(title, F.lit("")))), cut)


def clean_title(title: Column, feed_title: Column) -> Column:
    """Aggregator titles lose their trailing publisher."""
    bare = F.regexp_replace(title, r"\s[-–|]\s[^-–|]{2,60}$", "")
    return F.when(F.coalesce(feed_title, F.lit("")).rlike("(?i)google news"), bare).otherwise(F.coalesce(title, F.lit("")))


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def strip_channel(title: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+[|•]\s+[^|•]{2,40}$", "")
    return F.trim(F.regexp_replace(bare, r"#\S+", ""))


def slug(label: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(label), r"\s+", "-"), r"[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", "")


def tags(values: Column) -> Column:
    """Up to ten distinct cleaned lower-case tags, in order."""
    cleaned = F.transform(values, lambda v: F.lower(clean_text(v)))
    return F.slice(F.array_distinct(F.filter(cleaned, lambda v: v.isNotNull() & (v != ""))), 1, 10)


def decode_entities(value: Column) -> Column:
    """Named entities in sequence, so that a doubly escaped one unfolds; then numeric references."""
    out = value
    for name, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(name), F.lit(plain))
    return _decoded(_decoded(out, r"&#[xX]([0-9a-fA-F]+);", 16), r"&#([0-9]+);", 10)


def _decoded(value: Column, pattern: str, base: int) -> Column:
    char = lambda d: F.decode(F.unhex(F.lpad(F.hex(F.conv(d, base, 10).cast("long") % 65536), 4, "0")), "UTF-16BE")
    chars = F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(1)), char)
    glued = F.zip_with(F.split(value, pattern, -1), chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
    return F.when(value.rlike(pattern), F.array_join(glued, "")).otherwise(value)


def parse_list(value: Column) -> Column:
    """The strings of a JSON array; anything else is an empty list."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def story_title(title: Column, headline: Column, label: Column) -> Column:
    first = F.get(label, F.lit(0))
    capital = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, F.lit(2), F.length(first)))
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(headline, F.lit("")), F.nullif(capital, F.lit("")), F.lit("Untitled story"))


def decode_header(value: Column) -> Column:
    """=?base64?...?= headers as text; invalid ones as null."""
    wrapped = r"^=\?base64\?(.*)\?=$"
    decoded = F.try_to_binary(F.regexp_extract(value, wrapped, 1), F.lit("base64")).cast("string")
    return F.when(value.rlike(wrapped), decoded).otherwise(value)
