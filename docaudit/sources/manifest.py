"""Corpus manifests: read, verify against the files, upsert with drift detection."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.session import new_folder

MANIFEST = """
    documentos array<struct<arquivo: string, url: string, orgao: string, esfera: string,
        categoria: string, licenca: string, sha256: string, bytes: bigint,
        content_type_declarado: string, coletado_em: string, verificado_em: string,
        partes_xml: array<string>, midias: array<string>>>,
    falhas array<struct<url: string, orgao: string, erro: string, detalhe: map<string, string>,
        observado_em: string>>"""


class CorpusError(ValueError):
    """Files on disk are not the files that were collected."""


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, failures), each with one row per url."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    documents = raw.select(F.inline("documentos"))
    failures = raw.select(F.inline("falhas")).filter("url IS NOT NULL")
    return documents, failures


def verify_corpus(spark: SparkSession, documents: DataFrame, folder: str,
                  strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(verified, differing): manifest rows whose file exists, by content hash.

    The hash is computed where a file is read, so only names and hashes are shuffled. In strict mode files that
    differ are an error that says how many there are, which is the first, and where the table of all of them lies.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder)
             .select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("arquivo"),
                     F.sha2("content", 256).alias("found_sha256")))
    both = documents.join(files, "arquivo")
    differing = both.filter("found_sha256 <> sha256").select("arquivo", "sha256", "found_sha256")
    if strict:
        path = new_folder(spark, "divergencias")
        differing.write.parquet(path)
        differing = spark.read.schema(differing.schema).parquet(path)
        n, first = differing.agg(F.count(F.lit(1)), F.min("arquivo")).first()
        if n:
            raise CorpusError(f"sha256 divergente do manifesto em {n} arquivo(s), o primeiro {first}, todos em {path}. "
                              "O arquivo em disco nao e o que foi coletado; recolete antes de montar dataset.")
    fill = {"orgao": "desconhecido", "esfera": "desconhecida", "categoria": "desconhecida",
            "licenca": "nao declarada", "url": ""}
    kept = both.filter("found_sha256 = sha256").na.fill(fill).select(
        F.col("arquivo").alias("file"), "path", "sha256", F.col("orgao").alias("org"),
        F.col("esfera").alias("sphere"), F.col("categoria").alias("category"),
        F.col("licenca").alias("license"), "url")
    return kept, differing


@dataclass(frozen=True)
class Manifest:
    documents: DataFrame
    failures: DataFrame
    divergences: DataFrame


def upsert(documents: DataFrame, failures: DataFrame, fetched: DataFrame, now: str,
           accept_changes: bool = False) -> Manifest:
    """Fold fetched(url, sha256, file, error) into a manifest keyed by url.

    Another hash than the recorded one keeps the old row and is reported, unless accepted. A
    success clears an old failure; a failure never removes a document.
    """
    new = fetched.select("url", F.col("sha256").alias("new_sha"), F.col("file").alias("new_file"),
                         "error", F.lit(True).alias("tried"))
    both = documents.join(new, "url", "full_outer")
    ok = F.col("new_sha").isNotNull() & F.col("error").isNull()
    drift = ok & F.col("sha256").isNotNull() & (F.col("sha256") != F.col("new_sha"))
    refused = drift & F.lit(not accept_changes)
    taken = ok & ~F.coalesce(refused, F.lit(False))
    kept = both.filter(F.coalesce(taken, F.lit(False)) | F.col("sha256").isNotNull()).select(
        "url", F.coalesce("file", "new_file").alias("file"),
        F.when(taken, F.col("new_sha")).otherwise(F.col("sha256")).alias("sha256"),
        F.coalesce("collected_at", F.lit(now)).alias("collected_at"),
        F.when(taken, F.lit(now)).otherwise(F.col("verified_at")).alias("verified_at"))
    failed = new.filter("error IS NOT NULL").select(
        "url", F.col("error"), F.lit(now).alias("observed_at"))
    open_failures = failures.join(new.select("url"), "url", "left_anti").unionByName(failed)
    return Manifest(kept, open_failures, both.filter(refused).select("url", "sha256", "new_sha"))
