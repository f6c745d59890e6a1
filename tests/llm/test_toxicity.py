import random

import numpy as np
import pyarrow as pa

from clickloom.llm import toxicity
from clickloom.llm.common import chunks

from .helpers import frame


def table(spark, n=600, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    bad = ["Zorgle", "quux!"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        s = [[rng.choice(vocab) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 12))]
        at = rng.randrange(len(s))
        if toxic:
            s[at].insert(0, rng.choice([*bad, "vrask" + rng.choice(vocab)]))  # the last: a stem with many endings
        rows.append((i, ". ".join(" ".join(x) for x in s) + "."))
        labels.append((i, int(toxic), at))
    return rows, labels


def test_held_out_accuracy_and_offending_sentences(spark):
    rows, truth = table(spark)
    labels = spark.createDataFrame([(i, y) for i, y, _ in truth] + [(10_000, 1), (0, None), (1, 7)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(frame(spark, rows), labels).collect()}
    held = [i for i, _, _ in truth if got[i].held_out]
    assert len(held) > 60
    assert np.mean([got[i].predicted == truth[i][1] for i in held]) > 0.97
    text = dict(rows)
    for i in held:
        if truth[i][1] and got[i].predicted:
            starts = [0]
            for s in text[i].split(". ")[:-1]:
                starts.append(starts[-1] + len(s.encode()) + 2)
            assert starts[truth[i][2]] in [x.start for x in got[i].offending]


def test_gradient_fit_passes_the_blame():
    # Column 0 stands in every toxic document's one sentence, column 1 in sentences of all documents.
    doc = np.array([0, 0, 1, 2, 2, 3])
    sentence = np.array([0, 1, 2, 3, 4, 5])
    column = np.array([0, 1, 1, 0, 1, 1])
    weights, bias = toxicity.fit_bags(doc, sentence, column, np.zeros(4), np.array([1, 0, 1, 0]), 2)
    assert weights[0] + bias > 1 and weights[1] + bias < -1


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = [(5, None), (6, ""), (6, ""), (7, "a b. c"), (None, "x")]
    got = toxicity.score_documents(frame(spark, rows), labels).collect()
    assert len(got) == 5 and all(0 <= r.score < 0.1 and r.predicted == 0 and r.offending == [] for r in got)
    assert [r.score for r in got if r.doc_id in (5, 6)] == [0, 0, 0]
    assert toxicity.score_documents(frame(spark, []), labels).count() == 0


def test_sentences_and_beginnings():
    _, _, buf, off = next(chunks(pa.array(["Ab cd. éfgh!\nx", "", "..", "ab"])))
    features, sentence, text, start = toxicity.sentences(buf, off)
    assert sentence.tolist() == [0, 0, 1, 2, 3] and text.tolist() == [0, 0, 0, 3] and start.tolist() == [0, 7, 14, 17]
    assert features[0][0] == features[0][4] and (features[1] > 0).tolist() == [False, False, True, False, False]
