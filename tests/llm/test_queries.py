"""The queries over whole tables, and the pipeline's stages, against brute force, SQL, or held-out accuracy."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from rasterloom.llm import decontamination, queries
from rasterloom.llm.token_counts import accepted

from ..conftest import SMALL
from ..test_catalogue import same
from .helpers import base_pii, base_secrets, near_classes


@pytest.fixture(scope="module")
def texts(tables):
    return dict(tables.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, tables, name):
    same(queries.QUERIES[name](spark, SMALL).toPandas(), tables.execute(queries.ORACLE[name]).df())


@pytest.mark.parametrize(("name", "base"), [("op3_pii", base_pii), ("op10_secret_scan", base_secrets)])
def test_span_digests(spark, texts, name, base):
    for r in queries.QUERIES[name](spark, SMALL).collect():
        spelled = [f"{k}:{a}:{b}" for k, a, b in base(texts[r["doc_id"]] or "")]
        assert r["base_sha256"] == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert set(spelled) <= set(r["spans"].split(",")) | {""}


def test_neardup_query(spark, texts):
    want, sizes = near_classes(texts, 85)
    got = {r["doc_id"]: r for r in queries.op7_minhash_neardup(spark, SMALL).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want and {i: r["n_shingles"] for i, r in got.items()} == sizes


def test_token_query(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.byte_bpe())
    got = {r["doc_id"]: r for r in queries.op6_token_files(spark, SMALL).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_count_query(spark, texts):
    """Counts before and after the edits, against the library on the edited texts."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.byte_bpe())
    rows = queries.op9_token_counts(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["n_tokens"] == len(t.encode(text, add_special_tokens=False).ids)
        made = []
        for k, new in enumerate(("", " [edited]", "x")):
            start = int(hashlib.md5(f"edit{k}:{r['doc_id']}".encode()).hexdigest()[:12], 16) % (len(text) + 1)
            made.append({"start": start, "end": start + 4 * k, "text": new})
        chosen, edited, at = accepted(made, len(text)), "", 0
        for a, b, new in chosen:
            edited, at = edited + text[at:a] + new, b
        edited += text[at:]
        assert (r["n_edits"], r["n_tokens_edited"]) == (len(chosen), len(t.encode(edited, add_special_tokens=False).ids))


def test_language_query_on_held_out_documents(spark, tables):
    langs = dict(tables.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in queries.op5_language_id(spark, SMALL).collect() if r["held_out"]]
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_toxicity_query_shape(spark, texts):
    rows = queries.op2_toxicity(spark, SMALL).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_toxicity_query_on_held_out_documents(spark):
    """Recall and precision on documents whose labels the model has not seen, of a table with 449 toxic ones."""
    folder = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op2_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in toxic]
    caught = sum(r["predicted"] and toxic[r["doc_id"]] for r in rows)
    assert caught >= 0.8 * sum(toxic[r["doc_id"]] for r in rows)
    assert caught >= 0.9 * sum(r["predicted"] for r in rows)


def test_decontamination_query_finds_planted_passages(spark, tables, texts):
    items = dict(tables.execute("SELECT item_id, text FROM benchmark").fetchall())
    want = {(i, k) for i, t in texts.items() for k, x in items.items() if t and x and x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontamination(spark, SMALL).collect()}
    assert want <= got and len(got) <= len(want) + 3


def test_decontamination_query_equals_brute_force(spark, tables, texts):
    """Every window of every text against every item, by the checks alone."""
    items = {k: t for k, t in tables.execute("SELECT item_id, text FROM benchmark").fetchall() if t}
    own = {k: decontamination.Tokens([t.encode()]).hashes.tolist() for k, t in items.items()}
    want = set()
    for i, t in texts.items():
        words = decontamination.Tokens([(t or "").encode()]).hashes.tolist()
        for k, item in own.items():
            tail, n = decontamination._answer_words(items[k].encode(), len(item)), len(item)
            if (Counter(words) & Counter(item)).total() < decontamination.LOOSE * n:
                continue
            for at in range(0, len(words), decontamination.STRIDE):
                near = words[max(0, at - n) : at + decontamination.WINDOW + n]
                if (Counter(near) & Counter(item)).total() >= decontamination.LOOSE * n:
                    bits = decontamination.common_subsequence(item, near)
                    share, kept = bits.bit_count() / n, (bits >> (n - tail)).bit_count() / tail
                    if share >= decontamination.DIRECT or (share >= decontamination.LOOSE and kept >= decontamination.ANSWER):
                        want.add((i, k))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontamination(spark, SMALL).collect()}
    assert got == want and want


def test_pipeline_stages_of_odd_rows(spark, tmp_path):
    """Rows without id, repeated ids and repeated rows: copies and benchmark passages among them go as others do."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    text = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en' and n_chars between 500 and 2000").orderBy("doc_id").limit(3).collect()
    a, b, c = (r["text"] for r in text)
    rows = [(1, a), (None, a), (None, a), (None, f"{b} {item} {b}"), (2, b), (2, "A second text of that id, and of other words."), (None, c), (None, None), (3, "1234"), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], spark.read.parquet(f"{SMALL}/documents.parquet").schema)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
    got = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len([t for _, t in got if t == a]) == 1 and (None, c) in got
    assert not any(item in t for _, t in got) and len([i for i, _ in got if i == 2]) == 1 and len(got) == 3


def test_pipeline_stages(spark, tables, texts, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert docs.columns == columns
            kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    language, near, clean, mixed = kept
    assert set(language) == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    root, _ = near_classes({i: texts[i] for i in language}, 80)
    assert sorted(near) == sorted(i for i in language if root[i] == i)
    items = [x for (x,) in tables.execute("SELECT text FROM benchmark").fetchall()]
    leaked = {i for i in near if any(x in texts[i] for x in items)}
    assert set(clean) <= set(near) - leaked and len(clean) >= len(near) - len(leaked) - 3
    assert set(mixed) <= set(clean) and max(mixed.count(i) for i in set(mixed)) <= 3
    assert docs.count() == len(mixed)
    last = docs.orderBy("start").collect()
    assert last[0]["start"] == 0 and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(last, last[1:], strict=False))
