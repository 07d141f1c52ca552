import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, fp long, kept boolean, starts string, n_words string"


def _prose(rng, n):
    return " ".join("".join(rng.choice("aeiourstlnmé") for _ in range(rng.randint(1, 8))) + rng.choice(["", "", "", ",", ".", "!\n"]) for _ in range(n))


def _rows():
    rng = random.Random(11)
    passage = _prose(rng, 120)
    texts = [_prose(rng, rng.randint(1, 300)) for _ in range(40)]
    near = texts[3].split(" ") if len(texts[3].split(" ")) > 150 else _prose(rng, 260).split(" ")
    texts += [" ".join(near), " ".join([*near[:-1], "other"]), texts[5], texts[5], texts[5]]
    texts += [passage + " " + _prose(rng, 30), _prose(rng, 40) + " " + passage, _prose(rng, 20) + " " + passage + _prose(rng, 5)]
    texts += [None, "", " ", "one", "one two", "\n\n", "x" * 900, "ab" * 700, "line.\n" * 60, _prose(rng, 9000), "😀 é <|endoftext|> \x1c  中文 K"]
    texts += ["Licensed under the MIT License.", "The Apache License, Version 2.0 and CC BY-NC; cc by nc", "gnu general public license version 3"]
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "other", 7, True, "no", "w") for i, t in enumerate(texts)]
    rows.append(rows[44])  # a repeated row
    rows.append((44, "another text of the same id", None, None, None, None, None, None, None, None))
    rows.append((None, texts[2], None, None, None, None, None, None, None, None))
    return rows


ROWS = _rows()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
