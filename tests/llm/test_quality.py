import collections
import re

import pytest
from tables import SF, awkward, frame, words

from stratocast.llm.common import documents
from stratocast.llm.quality import PHRASES, SEPARATORS, TERMINALS, Rules, op7_quality, quality, quality_stage

RULES = Rules()


def good_line(line, earlier):
    ws = words(line)
    upper, lower = len(re.findall("[A-Z]", line)), len(re.findall("[a-z]", line))
    return not (
        not any(w.endswith(TERMINALS) for w in ws)
        or len(re.findall(r"[#*$%&|<>]", line)) > RULES.max_symbols_per_word * len(ws)
        or sum(w in SEPARATORS for w in ws) > RULES.max_separator_share * len(ws)
        or (upper >= RULES.min_upper_letters and upper > RULES.max_upper_share * (upper + lower))
        or any(p in line.translate({k: k + 32 for k in range(65, 91)}) for p in PHRASES)
        or line in earlier
    )


def plain(text):
    """(counts, base_failed, kept, cleaned) of one text."""
    text = text or ""
    ws, seen, dup, lost, out = words(text), set(), 0, 0, []
    for line in text.split("\n"):
        if not words(line):
            out.append(line)
            continue
        dup += line in seen
        if good_line(line, seen):
            out.append(line)
        else:
            lost += len(words(line))
        seen.add(line)
    grams = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
    count = collections.Counter(grams)
    cover = {j for k, g in enumerate(grams) if count[g] > 1 for j in range(k, k + 5)}
    base = len(ws) < 10 or 100 * len(cover) > 20 * len(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)), base, not base and lost <= RULES.max_lost_share * len(ws), "\n".join(out)


def check(rows, got):
    want = sorted((str(i), *plain(t)[0], *plain(t)[1:3]) for i, t in rows)
    have = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got)
    assert have == want


LINES = ["Good line here.", "Good line here.", "no end of it", "A | B | C.", "SHOUTING ALL THE TIME!!", "a### b$$$ c%%%.", "Please log in.", "", "Ünïcödé «tail».", "one two. three"]


def test_awkward_rows(spark):
    rows = awkward() + [(2000 + k, "\n".join(LINES[k:] * (k + 1))) for k in range(len(LINES))]
    check(rows, quality(frame(spark, rows)).collect())


def test_cleaned_text(spark):
    rows = [(k, "\n".join(LINES[k:])) for k in range(len(LINES))] + [(50, None)]
    got = {r.doc_id: r.cleaned for r in quality(frame(spark, rows)).collect()}
    assert got == {k: plain(t)[3] for k, t in rows}


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    check(rows, op7_quality(spark, SF).collect())


def test_labels_are_separated(spark):
    """Documents of good quality stay, others go."""
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/labels.parquet").dropDuplicates(["doc_id"])
    kept = quality(documents(spark, SF.replace("0.001", "0.1")), clean=False).join(labels, "doc_id")
    share = {r.quality: r.share for r in kept.groupBy("quality").agg({"kept": "count"}).join(kept.where("kept").groupBy("quality").count(), "quality", "left").selectExpr("quality", "coalesce(count, 0) / `count(kept)` share").collect()}
    assert share[1] > 0.95 and share[0] < 0.01


def test_stage_keeps_columns_and_drops_lines(spark):
    text = "\n".join(["Good words are in this line, and more of them.", "no end of it", "Another line that is fine, too."])
    df = frame(spark, [(1, text), (1, text), (2, None), (None, text)]).selectExpr("*", "99L AS n_chars")
    out = quality_stage(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted((str(r.doc_id), r.text.count("\n"), r.n_chars == len(r.text), r.n_words) for r in out.collect()) == [("1", 1, True, "7"), ("1", 1, True, "7"), ("None", 1, True, "7")]


@pytest.mark.parametrize("fn", [quality, quality_stage])
def test_empty_table(spark, fn):
    assert fn(frame(spark, [])).count() == 0


PROSE = "The design in this catalog in the library shows how a dialog in a novel is built, and readers who like cookies may read more about it here, as no one has to sign in for a chapter."


@pytest.mark.parametrize("times", [1, 40])
def test_long_clean_line_with_phrases_stays(spark, times):
    """A text of one long line is prose, whatever phrases it holds here and there."""
    more = [" ".join(f"{w}{k}" for w in PROSE.rstrip(".").split()) + "." for k in range(1, times)]
    text = " ".join([PROSE, *more])
    row = quality(frame(spark, [(1, text)])).first()
    assert (row.kept, row.lost_words, row.cleaned) == (True, 0, text)


def test_phrases_match_whole_words_only(spark):
    good = ["A design in blue.", "The catalog in print.", "One dialog in it.", "Bread more or less.", "Unsubscribed users are few.", "\u00fccookie is no word."]
    bad = ["Please sign in.", "LOG IN!", "(Read more)", "We use cookies.", "Cookie-settings.", "Click here: now.", "Subscribe.", "\u201cSubscribe\u201d now.", "\u00abCookies\u00bb here.", "\u8bf7cookie\u8bbe\u7f6e\u3002"]
    rows = [(k, f"{line}\nAnd here are some more words that make up a whole text for the test.") for k, line in enumerate(good + bad)]
    rows += [(100, "Click here, read more, log in, sign in, subscribe, share this. " + "Some words that follow it are here to make this one line long enough for the share.")]
    got = {r.doc_id: r.lost_words for r in quality(frame(spark, rows)).collect()}
    assert got == {k: 0 if k < len(good) else len(words((good + bad)[k])) for k in range(len(good + bad))} | {100: len(words(rows[-1][1]))}


def test_phrases_end_with_their_text(spark):
    """Texts that follow each other in memory are told apart."""
    rows = [(1, "log"), (2, " in here are ten good words of a text, and more."), (3, "The words of this text end with the words log in"), (4, "side of it are more words than ten, as it should be.")]
    got = {r.doc_id: r.lost_words for r in quality(frame(spark, rows).coalesce(1).orderBy("doc_id")).collect()}
    assert got == {1: 1, 2: 0, 3: 11, 4: 0}
