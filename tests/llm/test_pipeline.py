"""The whole pipeline on planted cases, against what each stage is to do."""

import random
import tracemalloc
import weakref
from collections import defaultdict

import pyarrow as pa
from test_text_operators import _jaccard, _prose

import corpus_pipeline
from gridwake.llm import jaccard_join, token_count
from gridwake.llm.common import materialize


def test_stages_on_planted_documents(spark, tmp_path):
    rnd = random.Random(12)
    rows, labels = {}, []
    for i in range(400):
        w = _prose(rnd, 80).split()
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            w.insert(rnd.randrange(len(w)), rnd.choice(["vilewort", "grubscum", "dolthead", "wormface"]))
        rows[i] = " ".join(w)
        labels.append((i, 1, toxic))
    junk = {1000 + i: " ".join(w.upper() + "!!" for w in _prose(rnd, 90).split()) for i in range(20)}
    copies = {2000 + i: rows[i + 1] + (" end" if i % 2 else "") for i in range(0, 40, 5)}
    docs = rows | junk | copies | {3000: None, 3001: ""}
    spark.createDataFrame([(i, t, "en", "s", 0, 7) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long, keep int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, kept, now = f"file://{tmp_path}", {}, None
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, d))
        if name != "packing":
            assert now.columns == columns
            kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert set(docs) - kept["quality"] == set(junk)
    gone = kept["quality"] - kept["toxicity"]
    toxic = {i for i in kept["quality"] if any(w in (docs[i] or "") for w in ("vilewort", "grubscum", "dolthead", "wormface"))}
    assert gone <= toxic and len(gone) >= 0.95 * len(toxic)
    classes = _jaccard([(i, docs[i]) for i in kept["toxicity"]])
    assert kept["near_duplicates"] == {i for i, (c, _) in classes.items() if c == i}
    assert kept["mixing"] <= kept["near_duplicates"]
    pieces, windows = defaultdict(list), defaultdict(int)
    for r in now.collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        windows[r.sequence_id] += r.length
    assert set(pieces) == kept["mixing"] and max(windows.values()) <= 2048
    assert windows
    for p in pieces.values():
        p.sort()
        assert p[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:])) and p[-1][0] + p[-1][1] == p[0][2]


def test_a_worker_holds_the_tables_of_one_operator(vocabulary):
    machine = weakref.ref(token_count.machine(vocabulary))
    assert token_count.machine(vocabulary) is machine()  # kept between tasks of one operator
    jaccard_join.words("a later stage in the same worker")
    assert machine() is None
    assert token_count.count_batch(["two words"], vocabulary) == [2]


def test_a_worker_tokenizes_in_bounded_memory(vocabulary):
    """What reading 2 MB leaves behind by state, and what it takes meanwhile."""
    rnd = random.Random(3)
    few = ["".join(rnd.choices("aeioustrnlm", k=rnd.randint(3, 9))) for _ in range(4000)]
    texts = pa.array([" ".join(rnd.choices(few, k=350)) for _ in range(1000)])
    m = token_count.Machine(vocabulary, small=True)
    tracemalloc.start()
    m.encode(texts, want_ids=True)
    left, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert left / len(m.transducer.states) < 300
    assert most - left < 25e6
