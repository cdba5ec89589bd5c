"""The pipeline against plain Python, and its stages one by one."""

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import pytest
import sentencepiece
from test_ngramjoin import brute
from test_small_operators import DOCS, brute_lines, odd_rows, plain_scores, prose

from gritstone.llm import shared
from gritstone.llm.queries import PIECE_MODEL, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(9)
    junk = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "|", "X9%%"]) for _ in range(60))
    texts = [prose(rng, 60) + "\n" + prose(rng, 20) if k % 4 else junk() for k in range(120)]
    texts += [texts[k] for k in (1, 2, 3)]  # copies
    texts += [texts[k].replace(" of", " off", 1) for k in (5, 6, 7)]  # near copies
    texts += [texts[9].split("\n")[0] + "\n" + prose(rng, 50), "", None]
    return [(k, t, "en", f"src{k % 3 and 1}", len(t or "")) for k, t in enumerate(texts)]


def write(spark, path, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def plain(rows, labels):
    """The five stages in Python."""
    known = {d: q for d, q, _ in labels if zlib.crc32(str(d).encode()) % 4 != 2}
    rows = [r for r, s in zip(rows, plain_scores([(r[0], r[1]) for r in rows], known), strict=True) if s >= 0.7]

    cut = brute_lines([(r[0], r[1]) for r in rows])
    rows = [(r[0], cut[r[0]], *r[2:4], r[4] if cut[r[0]] == r[1] else len(cut[r[0]])) for r in rows if cut[r[0]] == r[1] or cut[r[0]].strip()]

    group = {d: c for d, _, c in brute([(r[0], r[1]) for r in rows], 5, 80)}
    rows = [r for r in rows if group[r[0]] == r[0]]

    n = Counter(r[3] for r in rows)
    out = []
    for r in rows:
        mean = len(rows) / len(n) / n[r[3]]
        assert mean <= 16
        u = (int(hashlib.md5(f"17|{r[0]}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        copies, p = 0, math.exp(-mean)
        while p < u:
            copies += 1
            p += math.exp(-mean) * mean**copies / math.factorial(copies)
        out += [r] * copies
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    return Counter((*r, tuple(library.encode(r[1] or ""))) for r in out)


def test_run_is_plain_python(spark, tmp_path):
    rows = corpus()
    labels = [(k, int(k % 4 > 0), 0) for k in range(120)]
    write(spark, str(tmp_path), rows, labels)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((*[r[c] for c in COLUMNS], tuple(r.ids)) for r in got) == plain(rows, labels)
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    write(spark, str(tmp_path), odd_rows(), [(0, 1, 0)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[: len(COLUMNS)] == COLUMNS and docs.count() > 0, name
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_tables_go_after_their_last_reader(spark, monkeypatch, tmp_path):
    """What a written result leaves are the tables that the result itself reads."""
    monkeypatch.setattr(shared, "shared_folder", lambda _: f"file://{tmp_path}")
    sf = "/root/testdata/sf0.001"
    reads = {
        "op2_quality": {"quality"}, "op4_ngram_join": {"survey", "edges"}, "op8_url_filter": {"hosts"}, "op11_treaps": {"postings", "first-block"},
        "op13_align": set(), "op9_mixing": {"rates"}, "op10_passages": {"named", "representatives", "sides"}
    }
    for name, own in reads.items():
        before = {p.name for p in tmp_path.iterdir()}
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        left = {p.name.rpartition("-")[0] for p in tmp_path.iterdir() if p.name not in before}
        assert left <= own, (name, left)


def test_no_local_disk_on_a_cluster(spark):
    class Other:  # a session of a cluster, as far as shared_folder() looks at one
        class conf:
            get = staticmethod(lambda key, default=None: "file:/root/warehouse" if "warehouse" in key else default)

        class sparkContext:
            master = "yarn"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError):
        shared.shared_folder(Other)
