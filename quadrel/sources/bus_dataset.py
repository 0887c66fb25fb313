"""From BUS records, or a folder of them with its index, to a stored dataset in one call."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions.dna import dna_to_twobit, twobit_to_dna
from quadrel.matrix import COL, MAIN, ROW, AnnotatedMatrix
from quadrel.operators import records as rec
from quadrel.operators.cells import call_cells
from quadrel.sources import bus, storage, text

EXPECTED = 5000  # cells, where the sample's metadata names no number


def called_dataset(
    records: DataFrame, genes: DataFrame, length: int, layers: dict[str, DataFrame] | None = None, sample: str = "", attrs: dict | None = None,
    expected_cells: int = EXPECTED, sims: int = 1000, alpha: float = 0.01, most: int = 1500,
) -> AnnotatedMatrix:
    """The matrix of called cells of corrected and deduplicated ``records``, with what is known
    of every barcode beside it.

    The valid records are written once; the main layer, one further layer for each table of
    classes (ec) and the tests of barcodes are counted from them. Columns are the barcodes
    with an ambient p-value under ``alpha`` or more than ``most`` molecules, with CellID and
    TotalUMIs. The table ``barcodes`` has (barcode, TotalUMIs, AmbientPValue, Valid) of all of
    them; globals are SampleID, AmbientUMIs, RedundantReadFraction and ``attrs``.
    """
    total = records.count()
    valid = rec.valid_records(records)
    kept = valid.count()
    cells = rec.cell_index(valid)
    counted = {MAIN: rec.count_molecules(valid, cells)}
    counted |= {name: rec.count_molecules(valid, cells, classes) for name, classes in (layers or {}).items()}
    everything = AnnotatedMatrix.create(counted, genes, cells)
    ambient, called = call_cells(everything, expected_cells, sims=sims)
    good = (F.col("AmbientPValue") < alpha) | (F.col("TotalUMIs") > most)
    known = called.select(COL, F.col("total").alias("TotalUMIs"), F.col("padj").alias("AmbientPValue"))
    barcodes = cells.join(known, COL).withColumn("Valid", good.cast("int"))
    view = everything.view(None, barcodes.where("Valid = 1").select(COL))
    name = F.concat(F.lit(f"{sample}_"), twobit_to_dna(F.col("barcode"), length))
    cols = view.cols.join(barcodes.select("barcode", "TotalUMIs"), "barcode").select(COL, name.alias("CellID"), "TotalUMIs")
    made = {"SampleID": sample, "AmbientUMIs": ambient, "RedundantReadFraction": 1 - kept / total if total else 0.0, **(attrs or {})}
    return AnnotatedMatrix(view.rows, cols, view.layers, view.n_rows, view.n_cols, attrs=made, tables={"barcodes": barcodes.drop(COL)})


def chemistry(metadata: dict) -> str:
    """Name of the technology, by which the list of its barcodes is named."""
    if "technology" in metadata:
        return metadata["technology"]
    if "chemistry" in metadata:
        return f"10x{metadata['chemistry']}"
    raise ValueError("sample metadata need technology or chemistry")


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def from_bus(spark: SparkSession, folder: str, index: str, samples: str, sample: str, out: str, sims: int = 1000, most: int = 1500) -> AnnotatedMatrix:
    """Store the called cells of a folder of BUS records as a dataset at ``out``; gives it.

    ``folder`` holds output.bus, matrix.ec, transcripts.txt and, if there, run_info.json;
    ``index`` the manifest.json, which names the gene metadata (tab-separated with a header),
    its key, the genes of fragments and a list of fragments for every further layer, and
    ``<technology>_whitelist.txt``, without which barcodes are not corrected. ``samples`` is a
    table of sample metadata, of which all of the sample's values become globals.
    """
    manifest, metadata = read_json(spark, f"{index}/manifest.json"), text.read_sample_metadata(spark, samples, sample)
    technology = chemistry(metadata)
    try:
        expected = int(metadata.get("targetnumcells"))
    except (TypeError, ValueError):
        expected = EXPECTED
    there = lambda path: (lambda fs, to_path: fs.exists(to_path(path)))(*storage.file_system(spark, path))
    lines = lambda path: text.numbered_lines(spark, path)

    table = lines(f"{index}/{manifest['gene_metadata_file']}")
    head = table.where("line_no = 0").first().line.split("\t")
    cells = F.split("line", "\t")
    genes = table.where("line_no > 0 AND line <> ''").select((F.col("line_no") - 1).alias(ROW), *[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(head)])
    pairs = F.split("line", "\t")
    owners = lines(f"{index}/{manifest['fragments_to_genes_file']}").select(pairs[0].alias("name"), pairs[1].alias("key"))
    names = lines(f"{folder}/transcripts.txt").select(F.col("line_no").alias("fragment"), F.trim("line").alias("name"))
    fragments = names.join(owners, "name").join(genes.select(F.col(ROW).alias("gene"), F.col(manifest["gene_metadata_key"]).alias("key")), "key").select("fragment", "name", "gene")
    members = bus.parse_classes(lines(f"{folder}/matrix.ec"))
    raw, length, _ = bus.read_bus(spark, f"{folder}/output.bus")
    listed, path = None, f"{index}/{technology}_whitelist.txt"
    if there(path):
        listed = spark.read.text(path).select(dna_to_twobit(F.trim("value")).alias("barcode"))
    # A fragment without a gene makes its classes ambiguous, so members of all fragments count.
    owned = names.select("fragment").join(fragments.select("fragment", "gene"), "fragment", "left").select("fragment", F.coalesce("gene", F.lit(rec.MULTI)).alias("gene"))
    records = rec.deduplicate(rec.correct_barcodes(rec.with_genes(raw, rec.gene_of_class(members, owned)), listed, length))
    layers = {}
    for name, listing in manifest.get("layers", {}).items():
        own = spark.read.text(f"{index}/{listing}").select(F.trim("value").alias("name")).join(names, "name").select("fragment")
        layers[name] = rec.classes_with(members, own)
    attrs = {**metadata, "Species": manifest.get("species", "")}
    if there(f"{folder}/run_info.json"):
        info = read_json(spark, f"{folder}/run_info.json")
        renamed = {"n_processed": "NumReadsProcessed", "n_pseudoaligned": "NumPseudoaligned", "call": "KallistoCommand", "kallisto_version": "KallistoVersion"}
        attrs |= {to: info[k] for k, to in renamed.items() if k in info}
    made = called_dataset(records, genes, length, layers, sample, attrs, expected, sims, most=most)
    storage.save(made.set_global("Saturation", made.attrs["RedundantReadFraction"]), out)
    return storage.connect(spark, out)
