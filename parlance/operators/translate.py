"""Foreign-language blocks, their placeholders and their return; the translation model is a plug-in."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Code ranges, what may end a block, how far ahead it may go on, the placeholder's form.
RANGES = {"sinhala": "඀-෿", "tamil": "஀-௿"}
TERMINATORS = '.!?”"\n'
AHEAD = 10
SIGN = "§SIG"


def _block(letters: str) -> str:
    """From the first letter up to a terminator after which no letter comes soon; ends at a letter."""
    return rf"(?s)[{letters}].*?(?:[{TERMINATORS}](?![^{letters}]{{0,{AHEAD - 1}}}[{letters}])|\z)"


def first_block(c: Column) -> Column:
    """text and lang of the first foreign block; null if there is none."""
    at = {k: F.regexp_instr(c, F.lit(f"[{v}]")) for k, v in RANGES.items()}
    found = {k: F.regexp_replace(F.regexp_extract(c, _block(v), 0), rf"[^{v}]+$", "") for k, v in RANGES.items()}
    sinhala_first = (at["sinhala"] > 0) & ((at["tamil"] == 0) | (at["sinhala"] < at["tamil"]))
    pick = lambda k: F.struct(found[k].alias("text"), F.lit(k).alias("lang"))
    return F.when(sinhala_first, pick("sinhala")).when(at["tamil"] > 0, pick("tamil"))


_any = re.compile("[" + "".join(RANGES.values()) + "]")
_python = {k: (re.compile(f"[{v}]"), re.compile(_block(v).replace(r"\z", r"\Z"))) for k, v in RANGES.items()}


def sign(text: str, first: int = 1) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with a placeholder for each foreign block, and (placeholder, block, language) in order."""
    out, signs, at = [], [], 0
    while m := _any.search(text, at):
        lang = next(k for k, (one, _) in _python.items() if one.match(m[0]))
        letter, block = _python[lang]
        end = block.match(text, m.start()).end()
        while not letter.match(text[end - 1]):
            end -= 1
        name = f"{SIGN}{first + len(signs):04d}"
        out += [text[at : m.start()], name]
        signs.append((name, text[m.start() : end], lang))
        at = end
    return "".join([*out, text[at:]]), signs


def signed(c: Column) -> Column:
    """A struct of the text with placeholders and the list of them."""

    @F.pandas_udf("text string, signs array<struct<sign:string,text:string,lang:string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [sign(t or "") for t in texts]
        return pd.DataFrame({"text": [r[0] for r in rows], "signs": [[{"sign": a, "text": b, "lang": c} for a, b, c in r[1]] for r in rows]})

    return run(c)


def restored(text: Column, signs: Column, translate=lambda block: block) -> Column:
    """Placeholders replaced by their blocks' translations (identity by default); unknown ones stay."""
    return F.aggregate(signs, text, lambda t, s: F.replace(t, s["sign"], translate(s["text"])))


def _blocks(c: Column, marks: list[str]) -> Column:
    """The parts of a text that begin with a marker, as structs of marker and block."""
    escaped = "|".join(re.escape(m) for m in marks)
    parts = F.regexp_extract_all(c, F.lit(rf"(?s)(?:{escaped})(?:(?!{escaped}).)*"), F.lit(0))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, f"^({escaped})", 1).alias("mark"), F.trim(x).alias("block")))


def question_answer_pairs(rows, key: str = "doc_id", text: str = "text"):
    """key, place, mark (Q or A), block, foreign and lang of every marked block with foreign text, and ``pair``.

    A question's text ends with ?, an answer's with a full stop.  An answer belongs to the last question
    before it that has none yet; a pair is named by its question's place."""
    from parlance.functions.text import ANSWER_MARKERS, QUESTION_MARKERS, question_answer

    found = rows.select(key, F.posexplode(_blocks(F.col(text), [*QUESTION_MARKERS, *ANSWER_MARKERS])).alias("place", "b"))
    found = found.select(key, "place", F.col("b.block").alias("block"), question_answer(F.col("b.block")).alias("line")).withColumn("f", first_block(F.col("line")))
    found = found.where("f is not null").withColumn("mark", F.substring("line", 1, 1))
    ending = F.when(F.col("mark") == "Q", "?").otherwise(".")
    found = found.select(key, "place", "mark", "block", F.when(F.col("f.text").endswith(ending), F.col("f.text")).otherwise(F.concat("f.text", ending)).alias("foreign"), F.col("f.lang").alias("lang"))
    # A run of questions and answers: the first answer behind a question is its own.
    by_place = Window.partitionBy(key).orderBy("place")
    asked = F.when(F.col("mark") == "Q", F.col("place"))
    own = F.when((F.col("mark") == "A") & (F.lag("mark").over(by_place) == "Q"), F.lag("place").over(by_place))
    return found.withColumn("pair", F.coalesce(asked, own))


def chunks(text: str, most: int, split=str.split, join=" ".join) -> list[str]:
    """Sentences (cut at full stops and dandas) packed greedily into chunks of ``most`` tokens; a longer sentence is cut by tokens.

    ``split`` and ``join`` are the tokenizer's."""
    if len(split(text)) <= most:
        return [text]
    out, held = [], ""
    for sentence in filter(str.strip, re.split(r"[।.]", text)):
        more = f"{held} {sentence}".strip()
        if len(split(more)) <= most:
            held = more
            continue
        if held:
            out.append(held)
        tokens = split(sentence)
        held = "" if len(tokens) > most else sentence.strip()
        if not held:
            out += [join(tokens[i : i + most]).strip() for i in range(0, len(tokens), most)]
    return [*out, held] if held else out


def token_chunks(c: Column, most: int = 1024) -> Column:
    """Chunks of a text for a model that takes ``most`` tokens, by white space unless ``chunks`` is given a tokenizer."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else chunks(t, most))

    return run(c)
