"""P6 on texts of many lines, against a plain walk over them."""

import random
import re
import time

from utterlake.functions import parsing as P


def _plain(text):
    lines = [x.strip(" ") for x in re.split(r"\r\n|\n", text)]
    at = lambda i, letter: next((k for k in range(i + 1, len(lines)) if lines[k].startswith(f"{letter}:")), None)
    body = lambda k: re.sub(r"^[CRJ]:\s*", "", lines[k]).strip(" ")
    for c in reversed([k for k, x in enumerate(lines) if x.startswith("C:")]):
        r = at(c, "R")
        j = at(r, "J") if r is not None else None
        if j is not None:
            return body(c), body(r), body(j), True
    return "", "", "", False


def test_lines_are_read_once(spark):
    draw = random.Random(5)
    texts = ["\n".join(draw.choice(["C: a%d", "R:b%d ", " J: %d", "note %d", "", "C:", "R:", "J:"]).replace("%d", str(k)) for k in range(draw.choice([2, 4, 6, 9, 300]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string").repartition(4)
    start = time.monotonic()
    got = {r["key"]: tuple(r["x"]) for r in df.select("key", P.extract_crj("text").alias("x")).collect()}
    assert time.monotonic() - start < 60  # texts of 300 lines took hours when each line searched the others again
    assert got == {k: _plain(t) for k, t in enumerate(texts)}
