import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docaudit import constants as C
from docaudit.operators import audit as U
from docaudit.operators import collect as K
from docaudit.operators import dataset as DS
from docaudit.operators import events as E
from docaudit.operators import metrics as M
from docaudit.operators import ordered as OR
from docaudit.operators import rules as R
from docaudit.operators import score as S
from docaudit.operators import training as TR
from docaudit.sources import catalog, jsonl, manifest
from docaudit.streaming import consume as ST
from packages import drawing, p, package


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key."""
    rng = random.Random(7)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 400), i, rng.choice("abc"), rng.randrange(-3, 9))
            for i in range(6000)]
    return spark.createDataFrame(rows, "k int, o int, label string, v int").repartition(8).cache()


def _hash_of(df, key, value):
    return df.filter(F.col(key) == value).select(F.xxhash64(key)).first()[0]


def test_blocks_agree_with_plain_windows(skewed, monkeypatch):
    monkeypatch.setattr(OR, "BLOCKS", 16)
    args = dict(number="n", running={"s": F.col("v")}, previous={"before": ("label", "-")})
    run = lambda hot: sorted(map(tuple, OR.over_ordered(
        skewed, ["k"], ["o"], F.col("o"), hot=hot, **args).select("k", "o", "n", "s", "before").collect()))
    assert run([_hash_of(skewed, "k", 0)]) == run([])
    whole = lambda hot: sorted(map(tuple, OR.over_ordered(
        skewed, [], ["o"], F.col("o"), hot=hot, **args).select("o", "n", "s", "before").collect()))
    assert whole([0]) == whole([])


def test_every_heavy_key_is_found_and_cut(spark, monkeypatch):
    """One key with 40 % of the rows and a hundred more over the limit, through the only path."""
    monkeypatch.setattr(OR, "HOT_ROWS", 40)
    monkeypatch.setattr(OR, "BLOCKS", 8)
    rows = [(0, i, i % 5) for i in range(4000)] + [(1 + i % 100, i, i % 7) for i in range(5000)] + [(1000 + i, i, 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, o int, v int").repartition(8)
    assert len(OR.hot_keys(df, ["k"])) == 101
    w = W.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.row_number().over(w).cast("bigint").alias("n"), F.sum("v").over(w).alias("s"), F.lag("v", 1, -1).over(w).alias("b"))
    got = OR.over_ordered(df, ["k"], ["o"], F.col("o"), number="n", running={"s": F.col("v")}, previous={"b": ("v", -1)})
    assert sorted(map(tuple, got.select("k", "o", "n", "s", "b").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_join_casts_its_keys(spark, skewed, how):
    lookup = spark.createDataFrame([(i, f"x{i}") for i in range(0, 300)], "k bigint, x string")
    plain = sorted(map(tuple, skewed.join(lookup, "k", how).collect()), key=repr)
    assert sorted(map(tuple, OR.attach(skewed, lookup, "k", how).collect()), key=repr) == plain


@pytest.mark.parametrize("n", [1, 9_999, 10_000, 10_001, 30_000])
def test_digest_has_one_definition_at_every_size(spark, n):
    import hashlib
    rows = spark.range(n).select(F.lit("s").alias("slice"), F.col("id").alias("ord"), F.concat(F.lit("r"), "id").alias("id"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    blocks = [sha("".join(f"r{i}\0" for i in range(a, min(a + 10_000, n)))) for a in range(0, n, 10_000)]
    assert U.ordered_digest(rows, "slice", "ord", "id").first()["digest"] == sha(sha("".join(blocks)))


def test_refused_steps_change_nothing(spark):
    steps = ["RECEBIDA", "PROCESSANDO", "CONCLUIDA", "PROCESSANDO", "CONCLUIDA"]
    rows = [("a", i, i, s) for i, s in enumerate(steps)] + [("b", 9, 0, "PROCESSANDO"), ("b", 10, 1, "RECEBIDA"), ("b", 11, 2, "RECEBIDA"), ("b", 12, 3, "FALHOU")]
    log = spark.createDataFrame(rows, "analysis_id string, event_id int, ts int, state string")
    out = {r.event_id: (r.before, r.kind) for r in E.transitions(log).collect()}
    assert [out[i] for i in range(5)] == [(None, "primeira"), ("RECEBIDA", "legal"), ("PROCESSANDO", "legal"), ("CONCLUIDA", "ilegal"), ("CONCLUIDA", "ilegal")]
    assert [out[i] for i in range(9, 13)] == [(None, "ilegal"), (None, "primeira"), ("RECEBIDA", "ilegal"), ("RECEBIDA", "legal")]


def test_refused_calls_are_not_charged(spark):
    calls = spark.createDataFrame([(i, i, 600) for i in range(4)], "event_id int, ts int, cost_cents bigint")
    out = E.budget_gate(calls, F.lit("m"), F.col("ts"), cap=1000).orderBy("ts").collect()
    assert [(r.spent_before, r.blocked) for r in out] == [(0, False), (600, False), (1200, True), (1200, True)]


def test_equal_open_links_close_in_their_own_order(spark):
    from docaudit.sources.html import html_elements
    pages = spark.createDataFrame([("p", "<a href=x><a href=x>t</a>u</a>")], "page_id string, html string")
    assert [r.text for r in html_elements(pages).orderBy("seq").collect()] == ["tu", "t"]


def test_longest_run_by_brute_force(spark, skewed, monkeypatch):
    monkeypatch.setattr(OR, "HOT_ROWS", 1000)
    got = {r["k"]: r["longest_run"] for r in OR.longest_run(skewed, ["k"], ["o"], F.col("o"), "label").collect()}
    want, state = {}, {}
    for k, o, label, _ in sorted(map(tuple, skewed.collect()), key=lambda r: r[1]):
        last, n = state.get(k, (None, 0))
        state[k] = (label, n + 1 if label == last else 1)
        want[k] = max(want.get(k, 0), state[k][1])
    assert got == want


def test_top_n_is_trimmed_before_the_shuffle(skewed):
    plan = OR.top_per_group(skewed, ["label"], ["o"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 3, Partial" in plan


# ------------------------------------------------------------------- rate cap
def _brute(rows, cap, window):
    out, state = {}, {}
    for event, user, at in sorted(rows, key=lambda r: (r[2], r[0])):
        opened, n = state.get(user, (None, 0))
        if opened is None or at >= opened + window:
            opened, n = at, 0
        state[user] = (opened, n + 1)
        out[event] = n + 1 <= cap
    return out


@pytest.mark.parametrize("slices", [None, [(None, 40_000_000), (40_000_000, 41_000_000), (41_000_000, None)]])
def test_rate_cap_by_brute_force_and_in_slices(spark, slices):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5) if i % 3 else 0, rng.randrange(100_000_000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, t bigint").repartition(8)
    done = E.rate_cap(df, "user_id", F.col("t"), cap=7, window_seconds=5, slices=slices)
    assert {r["event_id"]: r["allowed"] for r in done.collect()} == _brute(rows, 7, 5_000_000)


def test_streamed_rate_cap_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((rng.randrange(10_000_000), i, rng.randrange(4)) for i in range(400))
    df = spark.createDataFrame([(i, u, t) for t, i, u in rows], "event_id bigint, user_id bigint, at bigint")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = ST.run_to_table(ST.rate_capped(stream, 5, 1, expire=False), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["event_id"]: r["allowed"] for r in out.collect()}
    batch = E.rate_cap(df, "user_id", F.col("at"), 5, 1)
    assert got == {r["event_id"]: r["allowed"] for r in batch.collect()}


def test_consumption_is_idempotent_and_routes_failures(spark, tmp_path):
    packages = spark.createDataFrame(
        [("a", package(p(drawing()))), ("b", bytearray(b"nada"))], "analysis_id string, content binary")
    events = spark.createDataFrame([("e1", "a"), ("e1", "a"), ("e2", "b"), ("e3", "sem")],
                                   "event_id string, analysis_id string")
    events.write.parquet(str(tmp_path / "in"))
    for attempt in ("one", "two"):  # the second run starts from nothing but finds the ledger
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        folder = lambda n: str(tmp_path / n)
        ST.consume(stream, ST.analyse(packages), folder("ledger"), folder("out"),
                   folder("cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out/findings"))
    assert found.groupBy("rule_id").count().filter("count > 1").count() == 0
    assert {r["rule_id"] for r in found.collect()} == {
        "IMAGEM_SEM_TEXTO_ALTERNATIVO", "TITULO_AUSENTE", "IDIOMA_NAO_DECLARADO"}
    letters = spark.read.parquet(str(tmp_path / "out/dead_letters"))
    assert sorted((r["event_id"], r["exception"]) for r in letters.collect()) == [
        ("e2", "ParteIlegivel"), ("e3", "BinarioAusente")]


# ----------------------------------------------------------------------- scores
def _score(spark, found, principles):
    docs = spark.createDataFrame([("d",)], "doc_id string")
    rows = spark.createDataFrame([("d", c, s) for c, s in found], "doc_id string, criterion string, severity string")
    return docs, rows, S.global_scores(docs, rows, principles).first()["global_score"]


def test_score_cases(spark):
    three = ["PERCEPTIVEL", "OPERAVEL", "COMPREENSIVEL"]
    docs, rows, _ = _score(spark, [("1.1.1", "ALTA"), ("1.3.1", "MEDIA"), ("1.4.3", "BAIXA")], three)
    first = S.principle_scores(docs, rows, three).filter("principle = 'PERCEPTIVEL'").first()
    assert (first["penalty"], first["score"]) == (26, 74)
    docs, rows, _ = _score(spark, [("1.1.1", "ALTA")] * 7 + [("1.1.1", "CRITICA")], three)
    first = S.principle_scores(docs, rows, three).filter("principle = 'PERCEPTIVEL'").first()
    assert (first["penalty"], first["score"]) == (130, 0)
    assert _score(spark, [("1.1.1", "ALTA"), ("2.4.4", "MEDIA")], three)[2] == 92
    assert _score(spark, [], three)[2] == 100
    assert _score(spark, [], [])[2] is None
    zero = dict.fromkeys(C.WEIGHTS, 0)
    assert S.global_scores(docs, rows, three, weights=zero).first()["global_score"] is None


def test_rules_must_cite_known_criteria():
    bad = R.Rule("X", "9.9.9", "ALTA", R.missing_titles)
    with pytest.raises(catalog.CatalogueError, match="9.9.9"):
        catalog.check_rules([bad])
    with pytest.raises(catalog.CatalogueError):
        catalog.applicability("talvez")
    assert catalog.applicability(" Direta ") == "DIRETA"
    skip = [(c, t, lv, "inaplicavel" if c == "3.1.1" else a) for c, t, lv, a in C.CRITERIA]
    assert R.evaluated_principles(criteria=skip) == ["PERCEPTIVEL", "OPERAVEL"]


# ------------------------------------------------------------------ agreement
@pytest.mark.parametrize("pairs, kappa", [
    ([("GOOD", "GOOD")] * 4, 1.0), ([("GOOD", "WEAK")] * 4, 0.0),
    ([("GOOD", "GOOD")] * 90 + [("WEAK", "GOOD")] * 10, 0.0),
    ([("GOOD", "GOOD"), ("WEAK", "WEAK"), ("GOOD", "WEAK"), ("WEAK", "WEAK")], 0.5)])
def test_kappa(spark, pairs, kappa):
    df = spark.createDataFrame(pairs, "a string, b string")
    assert M.agreement(df, "a", "b").first()["kappa"] == pytest.approx(kappa)
    with pytest.raises(ValueError):
        M.require_pairs(M.agreement(df.limit(0), "a", "b").first())


# --------------------------------------------------------------------- sources
def test_numbered_lines_over_several_blocks(spark, tmp_path):
    lines = ["" if i % 7 == 0 else json.dumps({"n": i}) for i in range(1, 20001)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, _ = jsonl.read_json_lines(spark, str(tmp_path / "a.jsonl"), "n int")
        assert rows.filter("n <> line_no").count() == 0
        assert rows.count() == sum(x != "" for x in lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("bad, message", [("{nao", "linha 3 nao e JSON valido"), ("[1]", "linha 3 nao e um objeto")])
def test_invalid_lines_are_named(spark, tmp_path, bad, message):
    (tmp_path / "b.jsonl").write_text('{"n": 1}\n\n' + bad)
    with pytest.raises(jsonl.JsonLinesError, match=message):
        jsonl.read_json_lines(spark, str(tmp_path / "b.jsonl"), "n int")
    assert jsonl.read_json_lines(spark, str(tmp_path / "b.jsonl"), "n int", strict=False)[0].count() == 1


def test_manifest_is_read_and_files_verified(spark, tmp_path):
    import hashlib
    content = bytes(package())
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.docx").write_bytes(content)
    doc = {"arquivo": "a.docx", "url": "u1", "sha256": hashlib.sha256(content).hexdigest(), "orgao": "O"}
    gone = {"arquivo": "x.docx", "url": "u2", "sha256": "0"}
    (tmp_path / "m.json").write_text(json.dumps({"documentos": [doc, gone], "falhas": [{"url": "u3", "erro": "e"}]}))
    documents, failures = manifest.read_manifest(spark, str(tmp_path / "m.json"))
    kept, _ = manifest.verify_corpus(spark, documents, str(tmp_path / "raw"))
    assert [(r["file"], r["org"], r["license"]) for r in kept.collect()] == [("a.docx", "O", "nao declarada")]
    assert failures.first()["erro"] == "e"
    (tmp_path / "raw/a.docx").write_bytes(content + b"x")
    with pytest.raises(manifest.CorpusError, match="em 1 arquivo.*a.docx") as error:
        manifest.verify_corpus(spark, documents, str(tmp_path / "raw"))
    assert spark.read.parquet(re.search("todos em ([^ ]+)[.] ", str(error.value))[1]).first()["arquivo"] == "a.docx"


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    rows = spark.range(3)
    jsonl.write_dataset(rows, str(tmp_path / "d"))
    with pytest.raises(Exception, match="already exists"):
        jsonl.write_dataset(rows, str(tmp_path / "d"))
    jsonl.write_dataset(rows.limit(1), str(tmp_path / "d"), overwrite=True)
    jsonl.write_report(rows.agg(F.max("id").alias("m")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["m"] == 2


# --------------------------------------------------------------------- dataset
def _rows(spark, n=30):
    rows = []
    for i in range(n):
        alt = f"Descricao numero {i} com {['mapa', 'foto', 'logo'][i % 3]} repetida"
        rows.append((i, f"id{i}", "x.docx", alt, "wikimedia-commons", None, alt.lower(), "treino" if i % 5 else "teste",
                     C.LABELS[i % 3], None, None))
    return spark.createDataFrame(rows, "ord int, id string, file string, alt string, source string, data_origin string,"
                                 "group_key string, split string, provisional_label string, label string,"
                                 "label_origin string")


def test_merge_is_idempotent_and_gates_are_ordered(spark):
    rows = _rows(spark)
    once = DS.merge(rows.filter("ord < 10"), rows).drop("appended")
    assert DS.merge(once, rows).filter("appended").count() == 0 and once.count() == 30
    samples, bad = DS.working_label(rows, "provisorio")
    DS.require_trainable(samples, bad)
    with pytest.raises(DS.DatasetError, match="vazamento"):
        leak = samples.withColumn("group_key", F.lit("g"))
        DS.require_trainable(leak, bad)
    with pytest.raises(DS.DatasetError, match="abaixo do minimo"):
        DS.require_trainable(samples.filter("ord < 5"), bad)
    _, violations = DS.working_label(rows.withColumn("split", F.lit("outra")), "provisorio")
    with pytest.raises(DS.DatasetError, match="linha 0: divisao"):
        DS.require_trainable(samples, violations)


@pytest.mark.parametrize("fault, broken", [
    ({"id": "if(ord = 3, 'id4', id)"}, {"A4 ids duplicados"}),
    ({"provisional_label": "if(ord = 3, 'SUFFICIENT', provisional_label)"},
     {"D1 rotulos dentro do enum canonico", "D1 nenhum SUFFICIENT sobrevivente", "C1 fila com o total",
      "C2 nenhuma classe devendo cota"}),
    ({"split": "if(ord = 3, 'x', split)"}, {"D2 divisao dentro das partes conhecidas"}),
    ({"label_origin": "'ninguem'"}, {"D2 origem_do_rotulo no vocabulario permitido"})])
def test_each_fault_fails_its_check(spark, fault, broken):
    expected = U.Expected(total=30, governmental=0, archive=30, synthetic=0, per_class=10, queue=30)
    fails = lambda rows: {r["name"] for r in U.audit(rows, expected).filter("status = 'FAIL'").collect()}
    base = fails(_rows(spark))
    assert base <= {"C3 sem vies de sequencia (bloco por classe)"}  # thirty rows mix by luck
    faulty = _rows(spark).withColumns({k: F.expr(v) for k, v in fault.items()})
    assert fails(faulty) - base == broken



# -------------------------------------------------------------------- training
def test_train_score_export_and_fallback(spark, tmp_path):
    texts = {"GOOD": "mapa detalhado da regiao numero {}", "WEAK": "foto simples {}", "INSUFFICIENT": "img_{}.png"}
    rows = [(f"{y}{i}", t.format(i), y, f"g{y}{i}", C.SPLITS[i % 3], False) for y, t in texts.items() for i in range(9)]
    samples = spark.createDataFrame(rows, "id string, text string, y string, group_key string, split string,"
                                    "synthetic boolean").cache()
    done = TR.train_and_evaluate(samples, max_iter=15)
    verdict = done.verdict.first().asDict()
    assert verdict["beats_baselines"] and verdict["measured_on"] == "validacao"
    with pytest.raises(TR.ExportRefused, match="NAO REVISADO"):
        TR.check_export("provisorio", True)
    with pytest.raises(TR.ExportRefused, match="nao supera"):
        TR.check_export("humano", False)
    TR.export(done.model, str(tmp_path / "m"), "humano", verdict, {"total": 27})
    again = TR.load(spark, str(tmp_path / "m"))
    one = [tuple(r) for r in TR.score(samples, done.model).select("id", "category").orderBy("id").collect()]
    assert one == [tuple(r) for r in TR.score(samples, again).select("id", "category").orderBy("id").collect()]
    assert TR.load(spark, str(tmp_path / "none")) is None
    rule = TR.score(samples, None).first()
    assert rule["used_heuristic"] and rule["confidence"] is None and rule["model_version"] is None


def test_folds_never_split_a_group_and_deal_classes_evenly(spark):
    rows = [(f"i{i}", "t", C.LABELS[i % 3], f"g{i // 2 * 3 + i % 3}", "treino", i % 5 == 0) for i in range(300)]
    samples = spark.createDataFrame(rows, "id string, text string, y string, group_key string, split string,"
                                    "synthetic boolean")
    folded = TR.assign_folds(samples, 5).cache()
    assert folded.count() == 300
    assert folded.groupBy("group_key").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    sizes = folded.select("group_key", "y", "fold").distinct().groupBy("y", "fold").count()
    spread = sizes.groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).agg(F.max("d")).first()[0]
    assert spread <= 1


@pytest.mark.parametrize("quota, read", [(3, 1024), (2000, 4096), (10**6, 6001)])
def test_pages_are_read_as_far_as_the_quota_needs(spark, tmp_path, capsys, quota, read):
    spark.range(6000).selectExpr("id page_ord").union(spark.sql("select null")).repartition(3).sortWithinPartitions(
        "page_ord").write.parquet(str(tmp_path / "pages"))
    parts = []

    def images(pages):
        parts.append(pages)
        return pages.select("page_ord", F.lit("u").alias("url"), F.lit(0).alias("idx"), F.lit(True).alias("has_alt"),
                            F.concat(F.lit("image"), "page_ord", F.lit(".png")).alias("alt"))

    got = K.collect_pages(spark.read.parquet(str(tmp_path / "pages")), quota, images)
    taken = [r.page_ord for r in got.accepted.orderBy("page_ord").collect()]
    assert taken == list(range(min(quota, 6000))) and got.totals.first()["accepted"] == len(taken)
    assert sum(p.count() for p in parts) == read + (read < 6000)  # and the page without a place
    for part in parts:
        part.explain("formatted")
    plans = capsys.readouterr().out
    assert plans.count("PushedFilters: [Or(IsNull(page_ord)") == 1
    assert plans.count("PushedFilters: [IsNotNull(page_ord), GreaterThanOrEqual(page_ord") == len(parts) - 1


def test_archive_is_read_as_far_as_the_limit_needs(spark):
    files = spark.range(-3, 20_000).selectExpr("id ord", "id pageid", "concat('Cena ', id % 900) caption", "'' description")
    got = K.collect_archive(files, 100)
    assert [r.ord for r in got.accepted.orderBy("ord").collect()][-1] == 96
    assert got.accepted.count() == 100 and {r.reason: r.files for r in got.totals.collect()} == {"duplicado": 0}
    assert K.collect_archive(files.limit(0), 5).accepted.count() == 0
    assert K.collect_archive(files, 10**6).accepted.count() == 903
