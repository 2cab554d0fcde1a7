"""Catalog export in XML: one pass over element records into flat tables of strings."""

from __future__ import annotations

import shutil
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

RECORD = "DataElement"
CONCEPT_FIELDS = ["PREFERRED_NAME", "CONCEPT_CODE", "DEFINITION", "EVS_SOURCE", "ORIGIN", "PRIMARY_FLAG", "DISPLAY_ORDER", "TYPE"]


def _record(*fields: str) -> StructType:
    return StructType([StructField(f, StringType()) for f in fields])


def _list_of(name: str, *fields: str, more: list[StructField] | None = None) -> StructType:
    inner = StructType([*_record(*fields).fields, *(more or [])])
    return StructType([StructField(name, ArrayType(inner))])


_CONCEPTS = StructField("ConceptDetails", _list_of("ConceptDetails_ITEM", *CONCEPT_FIELDS))
#: The schema is explicit: inference would turn ids and versions into numbers.
SCHEMA = StructType(
    [
        *_record("PUBLICID", "VERSION", "PREFERREDNAME", "SHORTNAME", "LONGNAME", "PREFERREDDEFINITION", "CONTEXTNAME", "CONTEXTVERSION", "WORKFLOWSTATUS", "REGISTRATIONSTATUS", "ORIGIN", "RAI").fields,
        StructField("DATAELEMENTCONCEPT", StructType([*_record("PublicId", "Version", "PreferredName", "LongName").fields, _CONCEPTS])),
        StructField("VALUEDOMAIN", StructType([*_record("PublicId", "Version", "PreferredName", "LongName", "ValueDomainType", "Datatype", "MinimumLength", "MaximumLength").fields, StructField("PermissibleValues", _list_of("PermissibleValues_ITEM", "VALIDVALUE", "VALUEMEANING", "MEANINGDESCRIPTION", "MEANINGCONCEPTS", "MEANINGCONCEPTORIGIN", "MEANINGCONCEPTDISPLAYORDER", "PVBEGINDATE", "PVENDDATE", "VMPUBLICID", "VMVERSION"))])),
        StructField("CLASSIFICATIONSLIST", _list_of("CLASSIFICATIONSLIST_ITEM", "ClassificationScheme", "ClassificationSchemeItemName", "ClassificationSchemeItemType", "CsiPublicId", "CsiVersion")),
        StructField("REFERENCEDOCUMENTSLIST", _list_of("REFERENCEDOCUMENTSLIST_ITEM", "Name", "DocumentType", "DocumentText", "URL", "Language", "DisplayOrder")),
        StructField("ALTERNATENAMELIST", _list_of("ALTERNATENAMELIST_ITEM", "ContextName", "ContextVersion", "AlternateName", "AlternateNameType", "Language")),
    ]
)


def first_text(*columns: Column) -> Column:
    """The first of columns that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def concepts_json(items: Column) -> Column:
    """Items with any value as JSON; null if there is none."""
    some = F.filter(items, lambda x: F.coalesce(*[x[f] for f in CONCEPT_FIELDS]).isNotNull())
    return F.when(F.size(some) > 0, F.to_json(some))


def unpacked(archive: str, folder: str) -> str:
    """The XML files of a zip archive, side by side in folder, which the executors must share: a folder for read_catalog.

    Driver-side; members are streamed. A file gets its name once it is whole; names that repeat in the archive are an error.
    """
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(archive) as z:
        members = {m: Path(m).name for m in z.namelist() if m.lower().endswith(".xml")}
        if not members or len(set(members.values())) < len(members):
            raise ValueError(f"{archive} has no XML file, or one name twice")
        for member, name in members.items():
            own = out / f".{name}.{uuid.uuid4().hex}"
            with z.open(member) as a, own.open("wb") as b:
                shutil.copyfileobj(a, b)
            own.rename(out / name)
    return folder


def read_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The seven tables of an export: a file, a folder or a pattern of XML files; see unpacked for a zip archive.

    Records without public id or version are skipped. Each table has the id, the version and the file; values are
    strings. Lists are exploded once; nothing is collected.
    """
    raw = spark.read.format("xml").option("rowTag", RECORD).schema(SCHEMA).load(path).withColumn("source_file", F.input_file_name())
    raw = raw.withColumns({"cde_publicid": first_text(F.col("PUBLICID")), "cde_version": first_text(F.col("VERSION"))}).filter("cde_publicid IS NOT NULL AND cde_version IS NOT NULL")
    key = ["cde_publicid", "cde_version", "source_file"]

    def items(column: str, names: dict[str, str]) -> DataFrame:
        rows = raw.select(*key, F.explode(column).alias("x"))
        return rows.select(*key, *[first_text(F.col(f"x.{f}")).alias(n) for f, n in names.items()])

    master = raw.select(*key, first_text(F.col("PREFERREDNAME"), F.col("SHORTNAME")).alias("preferred_name"), *[first_text(F.col(f)).alias(n) for f, n in {"LONGNAME": "long_name", "PREFERREDDEFINITION": "preferred_definition", "CONTEXTNAME": "context_name", "CONTEXTVERSION": "context_version", "WORKFLOWSTATUS": "workflow_status", "REGISTRATIONSTATUS": "registration_status", "ORIGIN": "origin", "RAI": "rai"}.items()])
    concept = raw.filter("DATAELEMENTCONCEPT IS NOT NULL").select(*key, *[first_text(F.col(f"DATAELEMENTCONCEPT.{f}")).alias(n) for f, n in {"PublicId": "dec_publicid", "Version": "dec_version", "PreferredName": "dec_preferred_name", "LongName": "dec_long_name"}.items()], concepts_json(F.col("DATAELEMENTCONCEPT.ConceptDetails.ConceptDetails_ITEM")).alias("concept_details"))
    domain = raw.filter("VALUEDOMAIN IS NOT NULL").select(*key, *[first_text(F.col(f"VALUEDOMAIN.{f}")).alias(n) for f, n in {"PublicId": "vd_publicid", "Version": "vd_version", "LongName": "vd_long_name", "ValueDomainType": "value_domain_type", "Datatype": "datatype"}.items()])
    values = items("VALUEDOMAIN.PermissibleValues.PermissibleValues_ITEM", {"VALIDVALUE": "valid_value", "VALUEMEANING": "value_meaning", "MEANINGDESCRIPTION": "meaning_description", "MEANINGCONCEPTS": "meaning_concepts", "MEANINGCONCEPTORIGIN": "meaning_concept_origin", "MEANINGCONCEPTDISPLAYORDER": "meaning_concept_display_order", "PVBEGINDATE": "pv_begin_date", "PVENDDATE": "pv_end_date", "VMPUBLICID": "vm_publicid", "VMVERSION": "vm_version"})
    classes = items("CLASSIFICATIONSLIST.CLASSIFICATIONSLIST_ITEM", {"ClassificationScheme": "scheme", "ClassificationSchemeItemName": "item_name", "ClassificationSchemeItemType": "item_type", "CsiPublicId": "csi_publicid", "CsiVersion": "csi_version"})
    documents = items("REFERENCEDOCUMENTSLIST.REFERENCEDOCUMENTSLIST_ITEM", {"Name": "name", "DocumentType": "document_type", "DocumentText": "document_text", "URL": "url", "Language": "language", "DisplayOrder": "display_order"})
    names = items("ALTERNATENAMELIST.ALTERNATENAMELIST_ITEM", {"ContextName": "context_name", "ContextVersion": "context_version", "AlternateName": "alternate_name", "AlternateNameType": "alternate_name_type", "Language": "language"})
    return {"master": master, "concept": concept, "value_domain": domain, "permissible_values": values, "classifications": classes, "reference_documents": documents, "alternate_names": names}


def name_tokens_by_type(names: DataFrame, n: int) -> DataFrame:
    """The n most frequent tokens of each alternate name type (the feature: a report)."""
    from weftline.functions.text import split_tokens
    from weftline.operators.ranking import first_rows

    counts = names.select("alternate_name_type", F.explode(split_tokens(F.col("alternate_name"))).alias("token")).groupBy("alternate_name_type", "token").agg(F.count(F.lit(1)).alias("n"))
    return first_rows(counts, ["alternate_name_type"], [F.desc("n"), F.asc("token")], n)
