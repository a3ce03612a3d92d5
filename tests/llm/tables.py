"""Small awkward tables for the text operators, and plain versions of what they compute."""

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "id long, th long, key string, kind int, at int, places string, rest string, n_words string, copy int, fp string, shard string, token_ids string, size int"


def words(text):
    return WORD.findall(text or "")


def texts(seed=0, n=60, vocabulary=12, longest=90):
    """Texts over few words, so that windows repeat a lot; with white space of all kinds and copies."""
    rng = random.Random(seed)
    bank = [rng.choice("abcdeäß漢") * rng.randint(1, 3) + rng.choice("xyz.") for _ in range(vocabulary)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.15:
            out.append(rng.choice(out))
            continue
        text = "".join(rng.choice(bank) + rng.choice((" ", " ", " ", "\n", "\t ", "  ", "\r\n", "\x0b")) for _ in range(rng.randint(0, longest)))
        if out and rng.random() < 0.5:
            text += rng.choice(out)[: rng.randint(0, 400)]
        out.append(text)
    return out


def awkward(seed=0):
    """(doc_id, text) rows: null, empty and blank texts, null and repeated ids, repeated rows, a very long text."""
    some = texts(seed)
    rows = list(enumerate(some))
    rows += [(None, None), (None, some[3]), (None, some[3]), (3, some[3]), (3, some[3]), (3, some[5] + " tail"), (7, None), (1000, ""), (1001, " \n\t\x0b "), (-5, some[8]), (1002, "w" * 5000), (1003, " ".join(some) * 6)]
    return rows


def frame(spark, rows, extra=True, columns="doc_id long, text string"):
    """The rows as a frame in some partitions, with columns whose names an operator might use itself."""
    df = spark.createDataFrame(rows, columns)
    if extra:
        for field in CLASHING.split(", "):
            name, kind = field.split(" ")
            df = df.selectExpr("*", f"CAST(7 AS {kind}) AS {name}")
    return df.repartition(3)


def sort_key(row):
    return tuple((x is not None, str(x)) for x in row)
