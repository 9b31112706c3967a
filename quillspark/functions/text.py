"""Text as native column expressions; every function takes and returns a Column.

Regular expressions are written in the form that Java and RE2 read alike, so the SQL in
``plans`` can use the same patterns.  White space is ASCII white space.

Java's regular expressions search from every character anew and call themselves for each turn of a
group.  Where that would be quadratic in a long run of one kind, or too deep, the pattern here
begins only where such a run begins (or where the last match ended) and never gives back what it
took; it finds what the plain pattern finds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx

# What counts as a word, a number, the end of a sentence, and a gap between paragraphs.
TOKEN = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
NUMBER = r"(?<![\p{L}\p{N}_])(?:\d{2,}|\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?)(?![\p{L}\p{N}_])"
SENTENCE_END = r"(?s)(\S.*?[.!?…])(\s)"
PARAGRAPH_GAP = r"((?:[ \t]*\r?\n[ \t]*){2,})"
MARK = "\u0001"
BLANKS = " \t\n\x0b\f\r"
#: The same patterns for Java.
JAVA_TOKEN = f"{TOKEN}+"
JAVA_GAP = r"(?:(?<![ \t])|\G)(?:[ \t]*+\r?\n){2,}+[ \t]*+"
JAVA_NUMBER = rf"(?=\d){NUMBER}"
#: What every gap holds.
JAVA_BLANK_LINE = r"\n[ \t]*+\r?\n"
#: A sentence without the white space around it: to the first . ! ? … after its first character that white space follows, or to the end.
JAVA_SENTENCE = r"\S[^.!?…]*+(?:[.!?…](?!\s)[^.!?…]*+)*+[.!?…]?+"
CYRILLIC = "[\u0400-\u04ff]"
#: Letters from rare to frequent.
RARE = "'-jzqxvkwybfpgcmudlhrsnioate "


def nonnull(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def tokens(c: Column) -> Column:
    """Lower-case words; inner apostrophes and hyphens stay."""
    return F.regexp_extract_all(F.lower(c), F.lit(JAVA_TOKEN), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(JAVA_TOKEN))


def space_word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f reads it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _sentences(c: Column) -> Column:
    # What follows the last end is left out of the search for ends, which would else look through it from each of its characters.
    ended = F.regexp_extract(c, r"(?s)^(.*[.!?…]\s)", 1)
    return once(ended, lambda e: F.split(F.concat(F.regexp_replace(e, SENTENCE_END, f"$1{MARK}$2"), F.substring(c, F.length(e) + 1, F.length(c))), MARK))


def sentences(c: Column) -> Column:
    """Runs up to . ! ? … before white space or the end, trimmed; blank ones dropped.  Linear in the text.  A MARK in the text ends one too."""
    return F.when(F.contains(c, F.lit(MARK)), F.filter(F.transform(once(c, _sentences), strip), lambda s: s != "")).otherwise(_unmarked_sentences(strip(c)))


def _unmarked_sentences(stripped: Column) -> Column:
    return F.regexp_extract_all(stripped, F.lit(JAVA_SENTENCE), F.lit(0))


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines, trimmed; blank ones dropped."""
    parts = F.split(F.regexp_replace(c, JAVA_GAP, MARK), MARK)
    # Most texts have no blank line and are not searched for the whole of a gap.
    parts = F.when(c.rlike(JAVA_BLANK_LINE) | F.contains(c, F.lit(MARK)), parts).otherwise(F.array(c))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def segments(c: Column, most: int = lx.SEGMENTS) -> Column:
    """Paragraphs, or the sentences of a single paragraph; at most `most`."""
    body = strip(F.replace(F.substring(c, 1, lx.SEMANTIC_CHARS), F.lit(MARK), F.lit(" ")))

    def of_one(block: Column, lone: Column) -> Column:
        return F.when(F.size(lone) > 1, lone).otherwise(block)

    return once(body, lambda b: once(paragraphs(b), lambda p: F.slice(F.when(F.size(p) == 1, once(_unmarked_sentences(b), lambda s: of_one(p, s))).otherwise(p), 1, most)))


def _holds(c: Column, phrase: str) -> Column:
    """Whether the phrase occurs.  Its end from the rarest letter on is looked for first, which few places in a text begin like."""
    at = min(range(max(len(phrase) - 3, 1)), key=lambda i: (RARE.find(phrase[i]), i))
    whole = F.contains(c, F.lit(phrase))
    return F.contains(c, F.lit(phrase[at:])) & whole if at else whole


def _over(c: Column, phrases: tuple[str, ...], of: Callable[[str], Column]) -> Column:
    """The sum of `of` over phrases, each 0 where its phrase doesn't occur.  A text without Cyrillic letters is not searched for phrases that begin with one."""
    theirs = [of(p) for p in phrases if re.match(CYRILLIC, p)]
    own = [of(p) for p in phrases if not re.match(CYRILLIC, p)]
    if theirs:
        own.append(F.when((F.octet_length(c) > F.length(c)) & c.rlike(CYRILLIC), sum(theirs[1:], theirs[0])).otherwise(F.when(c.isNotNull(), 0)))
    return sum(own[1:], own[0])


def distinct_hits(c: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases occur in the lower-cased text."""
    return _over(c, phrases, lambda p: _holds(c, p).cast("int"))


def hit_list(c: Column, phrases: tuple[str, ...], most: int = 3) -> Column:
    """The first phrases, in the list's order, that occur."""
    return F.slice(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(c, p)), 1, most)


def occurrences(c: Column, terms: tuple[str, ...]) -> Column:
    """Occurrences of all terms, none overlapping itself."""

    def count(t: str) -> Column:
        n = ((F.length(c) - F.length(F.replace(c, F.lit(t), F.lit("")))) / F.lit(len(t))).cast("int")
        return F.when(_holds(c, t), n).otherwise(F.when(c.isNotNull(), 0))

    return _over(c, terms, count)


def number_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(JAVA_NUMBER))


def space_key(c: Column) -> Column:
    """Lower-cased, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def fingerprint(c: Column) -> Column:
    return F.sha2(space_key(nonnull(c)), 256)


def ascii_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / F.greatest(F.length(c), F.lit(1))


def untagged(c: Column) -> Column:
    """Every tag as a space.  Nothing after the last > can be one."""

    def before(t: Column, tail: Column) -> Column:
        head = F.substring(t, F.lit(1), F.length(t) - F.length(tail))
        return F.concat(F.regexp_replace(head, r"<[^>]+>", " "), tail)

    return once(c, lambda t: before(t, F.substring_index(t, ">", -1)))


def mask(c: Column) -> Column:
    """The native part of the canonical clean-up: tags, addresses, control characters, white space, case."""
    # A pattern is tried only on a text that has what each of its matches has.
    c = once(c, lambda t: F.when(F.contains(t, F.lit("<")), untagged(t)).otherwise(t))
    c = once(c, lambda t: F.when(F.contains(t, F.lit("://")) | t.rlike(r"[wW]{3}\."), F.regexp_replace(t, r"(?i)(?:https?://|www\.)\S+", " url ")).otherwise(t))
    c = once(c, lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, r"(?:(?<![\p{L}\p{N}_.+-])|\G)[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_-]++\.[\p{L}\p{N}_.-]+", " email ")).otherwise(t))
    # Control characters and runs of white space; a lone space, which would only be put in its own place, is passed over.
    return F.lower(F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f][\x00-\x20\x7f]*+| [\x00-\x20\x7f]++", " ")))


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(untagged(c), r"\s+", " "))


def strip_fake_headers(c: Column) -> Column:
    """The body of a text that begins with a Return-Path header block holding a Subject; other texts unchanged."""
    raw = F.regexp_replace(c, r"^[\x{FEFF}\r\n]+", "")
    head = F.regexp_extract(raw, r"(?s)^(.*?)\r?\n\s*\r?\n", 1)
    body = F.regexp_replace(raw, r"(?s)^.*?\r?\n\s*\r?\n", "")
    fake = raw.rlike(r"(?i)^return-path\s*:") & raw.rlike(r"(?s)^.*?\r?\n\s*\r?\n") & head.rlike(r"(?mi)^Subject\s*:")
    return F.when(fake, body).otherwise(raw)


def clean_corpus_text(c: Column) -> Column:
    """Addresses and long numbers go, then quoted, list and rule lines; everything from "On ... wrote:" on goes."""

    def cleaned(s: Column) -> Column:
        """A line, in which every match lies; a pattern is tried only on a line that has what each of its matches has."""
        s = once(s, lambda t: F.when(F.contains(t, F.lit("://")) | t.rlike(r"[wW]{3}\."), F.regexp_replace(t, r"(?i)https?://\S+|www\.\S+", "")).otherwise(t))
        # What can't begin an address is skipped within its run and put back.
        s = once(s, lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, r"(?i)((?:(?<![\w.+%-])|\G)(?:(?!\b)(?:\w++|[.+%-]++))?)\b[\w.+%-]++@[\w.-]+\.[a-z]{2,}\b", "$1")).otherwise(t))
        s = F.regexp_replace(s, r"(?=[+\d])(?<![\p{L}\p{N}_])(?:\+?\d[\d .()-]{9,}\d)(?![\p{L}\p{N}_])", "")
        return strip(F.replace(s, F.lit("\r"), F.lit("")))

    def before_reply(lines: Column) -> Column:
        stops = F.transform(lines, lambda s: s.rlike(r"(?i)^on .{10,} wrote:\s*$"))
        return once(F.array_position(stops, F.lit(True)).cast("int"), lambda at: F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(lines))

    # Bound, so that lines are cleaned once and not once more for each reading of them.
    lines = once(F.transform(F.split(c, "\n"), cleaned), before_reply)
    # One ^ before all: Java then looks at the beginning only.
    noise = r"(?i)^(?:-{2,}\s*original message|unsubscribe|list-unsubscribe:|x-spam-|message-id:|\s*[-_=*~]{8,}\s*$|[>|])"
    kept = F.filter(lines, lambda s: ~s.rlike(noise))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def likely_human(subject: Column, body: Column) -> Column:
    words = F.regexp_count(body, F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?"))
    low = F.lower(F.concat(subject, F.lit(" "), F.substring(body, 1, 600)))
    return words.between(35, 650) & (ascii_ratio(body) >= 0.82) & (F.length(strip(subject)) >= 4) & (distinct_hits(low, lx.AUTOMATION) == 0)


def parse_label(c: Column) -> Column:
    """1, 0, or null for what is no label."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(*lx.POSITIVE_LABELS), 1).when(low.isin(*lx.NEGATIVE_LABELS), 0)


def fallback_score(c: Column) -> Column:
    """Share of four indicator stems, at most 1."""
    return F.round(F.least(distinct_hits(c, lx.INDICATORS) / F.lit(4.0), F.lit(1.0)), 4)


def has_sign_off(c: Column) -> Column:
    return c.rlike(r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(lx.SIGN_OFF) + r")(?:$|[^\p{L}\p{N}_])")


def signal_category(c: Column) -> Column:
    return F.replace(F.substring_index(c, ":", 1), F.lit("_"), F.lit(" "))


def subject_overlap(subject: Column, body: Column) -> Column:
    """Share of the subject's terms (3 or more characters, no stopwords) that the body has; null without terms."""
    stop = F.array(*map(F.lit, lx.SUBJECT_STOPWORDS))

    def terms(c: Column) -> Column:
        return F.array_except(F.filter(tokens(c), lambda t: F.length(t) >= 3), stop)

    s = F.array_distinct(terms(subject))
    return F.when(F.size(s) > 0, F.round(F.size(F.array_intersect(s, terms(body))) / F.size(s), 4))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
