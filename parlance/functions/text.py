"""Text cleaning, guards and tags as column expressions.  Fixed values are stated as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\n\x0B\f\r]+"

# Cues of precedents, phrases of invented origin, words that end a cut sentence, fragment starts.
PRECEDENT_CUES = [r"\bv\.\s", r"\bNLR\s+\d+", r"\bAIR\s+\d{4}", r"\b\d+\s+NLR\s+\d+", r"it was held that", r"was held that", r"stated at page", r"learned author", r"\.C\.J\.", r"\bVol\.?\s*\d+", r"\bpage\s+\d+", r"Butterworths"]
INVENTED_PHRASES = ["United States", "European Union", "U.S. District Court", "Supreme Court of the United States", "Court of Appeal of the United States", "Constitution of India"]
CUT_WORDS = ["the", "a", "an", "of", "and", "to", "in"]
FRAGMENT_STARTS = ["of the ", "and the ", "but the ", "which ", "that the "]
PAGE_LINES = [r"^\s*Page\s*\d+(\s*of\s*\d+)?\s*$", r"^\s*\d+\s+of\s+\d+\s*$", r"^\s*\d{1,3}\s*$"]
PROCEDURE_WORDS = ["section", "shall", "lodge", "notice of appeal", "form and manner", "procedure", "subsection", "hereinbefore"]
LEGAL_WORDS = r"(?i)\b(v\.|vs\.|Petitioner|Respondent|Court|Judge|Order|Judgment|Applicant|Plaintiff|Defendant)\b"


def any_of(patterns: list[str], flags: str = "i") -> str:
    return f"(?{flags})" + "|".join(f"(?:{p})" for p in patterns)


# Letters whose upper case by full mapping is several letters, and the one letter that a second engine's simple mapping gives.
WIDE = {chr(i): "\u1e9e" if chr(i) == "\u00df" else chr(i).title() for i in range(128, 0x10000) if not 0xD800 <= i < 0xE000 and len(chr(i).upper()) > 1}
WIDE = {k: v if len(v) == 1 else k for k, v in WIDE.items()}


def upper_letter(c: Column) -> Column:
    """One letter in upper case, which stays one letter."""
    up = F.upper(c)
    return F.when(F.length(up) > 1, F.translate(c, "".join(WIDE), "".join(WIDE.values()))).otherwise(up)


def lower(c: Column) -> Column:
    """Lower case, letter by letter: only the dotted capital I would become two."""
    return F.lower(F.translate(c, "\u0130", "i"))


def squeeze(c: Column) -> Column:
    """White space runs become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def strip_html(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), "&[a-zA-Z]+;", " "))


def strip_latex(c: Column) -> Column:
    """Formatting commands go, what they hold in braces stays."""
    c = F.replace(c, F.lit("\\n"), F.lit("\n"))
    for pattern, to in (("<[^>]+>", " "), ("&[a-zA-Z]+;", " "), (r"\\[a-zA-Z]+\{([^{}]*)\}", "$1"), (r"\\[a-zA-Z]+", " "), (r"[{}]", " "), (r"\\", " "), ("[\"\u201c\u201d\u2018\u2019]+", '"'), (r"[ \t\n\x0B\f\r]{2,}", " ")):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def clean_paragraphs(c: Column) -> Column:
    """Joins hyphenated and broken lines, keeps paragraph breaks."""
    for pattern, to in (("-\n", ""), ("([a-z])\n([a-z])", "$1 $2"), (",\n([a-z])", ", $1"), ("([^.!?])\n([a-z])", "$1 $2"), (r"(?<!\n)\n(?!\n)", " "), (" {2,}", " "), (r"\n{2,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def page_line(c: Column) -> Column:
    return c.rlike(any_of(PAGE_LINES))


def garbled(c: Column, run: int = 5, quoted_run: int = 4) -> Column:
    """Looks like text read in a wrong encoding."""
    hard = "[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ;=]{%d,}"
    words = F.filter(F.split(c, SPACES), lambda w: w != "")
    bad_word = F.exists(words, lambda w: (F.length(w) - F.length(F.replace(w, F.lit(";"), F.lit(""))) > 1) | (F.length(w) - F.length(F.replace(w, F.lit(","), F.lit(""))) > 1) | w.rlike(r"[<>{}^+@\\|]") | (~w.rlike(r"^\p{Lu}") & w.rlike(hard % run)))
    quoted = F.exists(F.regexp_extract_all(c, F.lit('(?s)[(\\["\u201c\u2018](.+?)[)\\]\u201d\u2019"]'), F.lit(1)), lambda q: q.rlike(hard % quoted_run))
    return c.rlike("[\u0d80-\u0dff\u00fa\u00ef\u00f1\u00ff]") | bad_word | quoted


def language_tag(c: Column) -> Column:
    sinhala, tamil = c.rlike("[\u0d80-\u0dff]"), c.rlike("[\u0b80-\u0bff]")
    return F.when(sinhala & tamil, "mixed").when(sinhala, "sinhala").when(tamil, "tamil")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, SPACES), lambda w: w != ""))


def length_factor(c: Column) -> Column:
    n = word_count(c)
    return F.when(n < 10, 0.5).when(n > 100, 0.8).otherwise(1.0)


def statutory_fragment(c: Column) -> Column:
    t = F.substring(F.trim(c), 1, 120)
    return (F.length(F.trim(c)) >= 20) & ((t.startswith("(") & F.substring(t, 1, 15).contains(")")) | t.rlike(r"(?i)^\s*\(i+\)") | t.rlike(r"(?i)^\s*\([a-d]\)"))


def procedure_heavy(c: Column) -> Column:
    """At least two of the words, as parts of words too."""
    low = F.lower(c)
    total = F.lit(0)
    for k in PROCEDURE_WORDS:
        total = total + low.contains(k).cast("int")
    return total >= 2


def cites_precedent(c: Column) -> Column:
    return c.rlike(any_of(PRECEDENT_CUES))


def guard(original: Column, summary: Column, least: int = 15) -> Column:
    """Why a rewritten clause is refused; null if it may be used.  Checks in order, the first counts."""
    s, o = F.trim(summary), F.trim(F.coalesce(original, F.lit("")))
    low = lower(s)
    last = F.element_at(F.split(low, SPACES), -1)
    invented = F.lit(False)
    for p in INVENTED_PHRASES:
        invented = invented | (s.contains(p) & ~lower(o).contains(p.lower()))
    starts = F.lit(False)
    for p in FRAGMENT_STARTS:
        starts = starts | low.startswith(p)
    sentences = F.transform(F.filter(F.split(s, r"[.!?]"), lambda x: F.trim(x) != ""), lambda x: F.lower(F.trim(x)))
    pairs = F.regexp_extract_all(s, F.lit(r"\b(\w+)\s+\1\b"), F.lit(0))
    marks = lambda c: F.regexp_count(c, F.lit(r"\([a-e]\)"))
    return (
        F.when(s.isNull() | (F.length(s) < least), "too_short")
        .when(invented, "invented_phrase")
        .when((F.length(s) >= 30) & ~s.rlike("[.?!\"']$") & last.isin(CUT_WORDS), "truncated")
        .when((F.length(s) >= 25) & (s.rlike(r"^\p{Ll}") | starts), "fragment")
        .when((F.length(s) >= 36) & s.rlike(r"(?s)(?=.{0,59} )(.{12,60})(?:\s+\1)+"), "repetition")
        .when(F.size(sentences) > F.size(F.array_distinct(sentences)), "repeated_sentence")
        .when(F.exists(pairs, lambda m: ~o.contains(m)), "doubled_word")
        .when(marks(o) > marks(s), "lost_enumeration")
    )


def minimal_cleanup(c: Column) -> Column:
    for pattern, to in (("(?i)<n>", " "), (SPACES, " "), (r"^ | $", ""), (r"(?i)Article 11\s+that\s+Article 11", "Article 11"), (r"(?i)arbitrarily\s+arbitrary", "arbitrary"), (r"(?i)\bis\s+entitlement\s+to\b", "is entitled to"), (r"(?i)\bthe\s+1\s+first\s+", "the 1st "), (r"(?i)\bfirst\s+limbs\b", "first limb"), (r"\b(\d+)\.\1\.\s+", "$1. ")):
        c = F.regexp_replace(c, pattern, to)
    return c


# Markers of questions and answers, in the order in which they are tried.
QUESTION_MARKERS = ["\u0db4\u0dd4:", "Q.", "Q:"]
ANSWER_MARKERS = ["A:", "A.", "\u0d8b:", "c:", "C:"]
BODY_MARK = "=== BODY ==="


def question_answer(c: Column) -> Column:
    """A line's question or answer marker as Q: or A:."""
    t = F.trim(c)
    out = t
    for kind, marks in (("A:", ANSWER_MARKERS), ("Q:", QUESTION_MARKERS)):
        for m in reversed(marks):
            out = F.when(t.startswith(m), F.concat(F.lit(kind), F.trim(F.substr(t, F.lit(len(m) + 1))))).otherwise(out)
    return out


def body_lines(c: Column) -> Column:
    """The non-blank lines after the body mark; none without the mark."""
    parts = F.split(c, BODY_MARK, 2)
    return F.when(F.size(parts) > 1, F.filter(F.transform(F.split(parts[1], "\n"), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def joined_body(c: Column) -> Column:
    """Everything up to the body mark as it is, the body's lines joined by one space."""
    parts = F.split(c, BODY_MARK, 2)
    return F.when(F.size(parts) > 1, F.concat(parts[0], F.lit(BODY_MARK + "\n"), F.array_join(body_lines(c), " "))).otherwise(c)


def edge_numbers(c: Column) -> Column:
    """A line without page-like numbers at its ends; fractions, enumerations and years stay."""
    dash = "[-\u2013\u2014:)]*"
    lead = rf"(?i)^\s*(?:\d{{1,3}}(?![A-Za-z])\s*{dash}\s*|\d{{1,3}}\s+of\s+\d{{1,3}}\s*{dash}\s*)"
    trail = r"(?i)(?:[-\u2013\u2014:(]*\s*\d{1,3}\s*|\s*\d{1,3}\s+of\s+\d{1,3}\s*)\s*$"
    first, last = F.regexp_extract(c, r"^\s*(\S+)", 1), F.regexp_extract(c, r"(\S+)\s*$", 1)
    many = lambda t: F.length(F.regexp_replace(t, r"\D", "")) >= 4
    cut = lambda x, p: F.regexp_replace(x, p, "")
    plain = cut(cut(cut(cut(cut(c, r"(?i)^\s*Page\s*\d+\s*(?:of\s*\d+)?\s*"), lead), trail), r"(?i)^\s*of\s+\d{1,3}\s*[-\u2013\u2014:]?\s*"), r"(?i)\s*[-\u2013\u2014:]?\s*of\s+\d{1,3}\s*$")
    listed = c.rlike(r"^\(?\d{1,3}[.)]\s")
    return (
        F.when(c.rlike(r"^\s*\d+/[A-Za-z0-9]") | (c == ""), c)
        .when(listed & many(last), F.trim(c))
        .when(listed | many(first), F.trim(cut(c, trail)))
        .when(many(last), F.trim(cut(c, lead)))
        .otherwise(F.trim(plain))
    )


def keep_safely(original: Column, candidate: Column) -> Column:
    """The cleaned line; the original where it holds a legal word, or where cleaning leaves nothing of some letters."""
    letters = F.length(F.regexp_replace(original, "[^A-Za-z]", "")) >= 3
    return F.when(original.rlike(LEGAL_WORDS), F.trim(original)).when((F.trim(candidate) == "") & letters, F.trim(original)).otherwise(F.trim(candidate))


def chosen_summary(final: Column, bullets: Column) -> Column:
    """The final text, else the bullets joined; without the note on compression."""
    text = F.coalesce(F.when(final != "", final), F.array_join(F.filter(bullets, lambda b: b != ""), "\n"))
    return F.trim(F.regexp_replace(F.trim(text), r"(?i)\s*\(compressed from selected clauses\)\s*", " "))


def reasoning_part(c: Column) -> Column:
    """What stands between the reasoning and holding headings of a summary."""
    after = F.when(c.contains("Key reasoning"), F.trim(F.element_at(F.split(c, "Key reasoning", 2), -1))).otherwise(c)
    after = F.when(after.contains("compressed from selected clauses):"), F.trim(F.element_at(F.split(after, r"\):", 2), -1))).otherwise(after)
    return squeeze(F.when(after.contains("Key holding"), F.split(after, "Key holding", 2)[0]).otherwise(after))


def natural_key(c: Column) -> Column:
    """Sorts digit runs by value and letters without case."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


# Rewritings to the third person, in the order in which they are applied.
THIRD_PERSON = [
    (r"\bI\s+therefore\s+hold\b", "The Court therefore held"),
    (r"\bI pointed out\b", "The Court pointed out"),
    (r"\bI\s+set\s+aside\b", "The Court set aside"),
    (r"\bI affirm\b", "The Court affirmed"),
    (r"\bI answer\b", "The Court answers"),
    (r"\bI\s+hold\b", "The Court holds"),
    (r"\bI find\b", "The Court finds"),
    (r"\bI dismiss\b", "The Court dismisses"),
    (r"\bI allow\b", "The Court allows"),
    (r"\bI proceed to dismiss\b", "The Court proceeds to dismiss"),
    (r"\bI am of the view\b", "The Court is of the view"),
    (r"\bI am of the considered opinion\b", "The Court was of the considered opinion"),
    (r"\bI agree\b", "The Court agreed"),
    (r"\bwe are of the opinion\b", "The Court is of the opinion"),
    (r"\bwe find\b", "The Court finds"),
    (r"\bwe hold\b", "The Court holds"),
    (r"\bIn my view\b", "In the Court's view"),
    (r"\bIn our view\b", "In the Court's view"),
    (r"\bmy view\b", "the Court's view"),
    (r"The Court finds myself\b", "The Court finds itself"),
    (r"The Court found myself\b", "The Court found itself"),
    (r"\bI find myself\b", "The Court finds itself"),
    (r"\bI (?:am|was) mindful\b", "The Court is mindful"),
    (r"\bI have to hold\b", "The Court had to hold"),
    (r"\bI direct\b", "The Court directs"),
    (r"enumerated by me\b", "enumerated above"),
    (r"observed by me\b", "observed by the Court"),
    (r"It appears to me\b", "It appears to the Court"),
    (r"\bI took the view\b", "The Court took the view"),
    (r"\bI unhesitatingly reject\b", "The Court unhesitatingly rejected"),
    (r"\bI further declare\b", "The Court further declares"),
    (r"\bI therefore, set aside\b", "The Court therefore set aside"),
    (r"\bI declare\b", "The Court declares"),
    (r"\bI am not inclined to hold\b", "The Court is not inclined to hold"),
    (r"\bI uphold\b", "The Court upholds"),
    (r"\bI order\b", "The Court orders"),
    (r"\bI consider\b", "The Court considers"),
    (r"\bI observe\b", "The Court observes"),
    (r"\bI find\b", "The Court finds"),
    (r"\bWe direct\b", "The Court directs"),
    (r"\bWe are\b", "The Court is"),
    (r"\bI make\b", "The Court makes"),
    (r"\bI overrule\b", "The Court overrules"),
    (r"\bI consider it appropriate\b", "The Court considers it appropriate"),
    (r"\bwe wish to note\b", "The Court wishes to note"),
    (r"\bWe are empowered\b", "The Court is empowered"),
    (r"\bWe observe\b", "The Court observes"),
    (r"\bwe proceed to\b", "The Court proceeds to"),
    (r"\bWe also proceed to\b", "The Court also proceeds to"),
    (r"\bwe are unable to see\b", "The Court is unable to see"),
    (r"\bwe can direct\b", "The Court can direct"),
    (r"\bwe specify\b", "The Court specifies"),
    (r"\bwe have quashed\b", "The Court has quashed"),
    (r"\bwe are mindful\b", "The Court is mindful"),
    (r"\bI am of the opinion\b", "The Court is of the opinion"),
    (r"\bI refuse\b", "The Court refuses"),
]
VERBS_AFTER_CONJUNCTION = ["denied", "held", "found", "stated", "allowed", "rejected", "affirmed", "dismissed", "ordered", "rather", "concluded", "ruled", "determined", "noted", "observed", "accepted", "refused", "reversed", "remanded", "applied", "considered", "decided"]


def third_person(c: Column) -> Column:
    out = F.trim(c)
    for pattern, to in THIRD_PERSON:
        out = F.regexp_replace(out, f"(?i){pattern}", to)
    return F.regexp_replace(out, r"\b(\d+)\.\1\.\s+", "$1. ")


def repaired_start(c: Column) -> Column:
    """A line that starts with a conjunction as a statement of what the Court noted."""
    s = F.trim(c)
    lower_first = lambda x: F.concat(F.lower(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))
    rest = lambda n: F.ltrim(F.substr(s, F.lit(n + 1)))
    verb = lambda x: F.lower(F.split(x, SPACES)[0])
    noted = lambda x: F.concat(F.when(verb(x).isin(VERBS_AFTER_CONJUNCTION), "The Court noted that it ").otherwise("The Court noted that "), lower_first(x))
    but = rest(4)
    low = F.lower(s)
    return (
        F.when(
            low.startswith("but ") | low.startswith("but,"),
            F.when(verb(but) == "denied", F.concat(F.lit("The Court noted that the Respondent "), lower_first(but)))
            .when(verb(but) == "rather", F.concat(F.lit("The Court noted that the provision applies rather "), lower_first(F.ltrim(F.substr(but, F.lit(7))))))
            .otherwise(noted(but)),
        )
        .when(low.startswith("even though "), noted(rest(12)))
        .when(low.startswith("even "), noted(rest(5)))
        .when(low.startswith("and the "), F.concat(F.lit("The Court noted that "), lower_first(rest(8))))
        .otherwise(c)
    )
