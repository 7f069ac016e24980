import random

import pytest

WORDS = "the of and thnd erstion reha only with thou onble Étion schön ñdo 'tis x-y don't %% 42 THE".split()
#: Names that the operators use themselves: extra columns may have them.
CLASH = {"id": 1, "chunk": 2, "bucket": 3, "row_key": 4, "n": 5, "v": 6, "noise": 7.0, "good": 8, "part": 9, "look": 10, "piece": 11, "c0": 12, "kept": "x", "w": "y", "log_weight": 0.5, "form": "f", "l": 13, "train": True}


@pytest.fixture(scope="session")
def make(spark):
    """Documents with clashing extra columns from (doc_id, text) rows."""
    from loomspan.llm import shared

    shared.importable(spark)

    def build(rows, id_type="long"):
        kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
        schema = f"doc_id {id_type}, text string, " + ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in CLASH.items())
        return spark.createDataFrame([(*r, *CLASH.values()) for r in rows], schema)

    return build


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + (str(rnd.randrange(60)) if rnd.random() < 0.7 else "") for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Random prose with exact and near copies, shared passages, runs, nulls, empty, blank, tiny, repeated and long texts."""
    rnd = random.Random(1)
    rows = [(i, prose(rnd, rnd.randrange(1, 130))) for i in range(120)]
    passage = prose(rnd, 60)
    for i in range(120, 130):
        rows.append((i, f"{prose(rnd, 20)} {passage}\n{prose(rnd, 10)}"))
    rows += [(i, rows[3][1]) for i in range(130, 136)]
    base = prose(rnd, 200).split(" ")
    for i in range(136, 150):
        copy = list(base)
        for _ in range(rnd.randrange(0, 4)):
            copy[rnd.randrange(len(copy))] = f"edit{rnd.randrange(9)}"
        rows.append((i, " ".join(copy)))
    rows += [(150, None), (151, ""), (152, " \n\t "), (153, "one"), (154, "a b c d"), (155, "a b c d"), (156, "run " * 90), (157, "run " * 50 + "end"), (158, "ab " * 40 + "cd " * 40), (159, prose(rnd, 4000))]
    rows += [(160, passage), (160, passage), (None, prose(rnd, 50)), (None, None), (161, "nb sp   wide \x0b tab\x1cfs"), (162, " ".join(base).upper())]
    return rows
