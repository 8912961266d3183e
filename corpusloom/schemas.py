"""Explicit schemas. No reader in this package infers one."""

from pyspark.sql import types as T

TAGS = T.ArrayType(T.StringType())
EXTRA = T.MapType(T.StringType(), T.StringType())

DOC = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("tags", TAGS),
    T.StructField("evidence_level", T.StringType()),
    T.StructField("journal", T.StringType()),
    T.StructField("doi", T.StringType()),
    T.StructField("extra", EXTRA),
])
DOC_FIELDS = DOC.fieldNames()

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("doc_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("tags", TAGS),
    T.StructField("evidence_level", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
])
CHUNK_FIELDS = CHUNK.fieldNames()

QUESTION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("track", T.StringType()),
    T.StructField("must_cite", T.BooleanType()),
    T.StructField("gold_points", TAGS),
])

CURATED = T.StructType([
    T.StructField(n, T.IntegerType() if n == "year" else T.StringType())
    for n in ["id", "title", "text", "year", "url", "doi", "journal", "source_type",
              "evidence_role", "authors", "pmcid", "nct", "abstract_en"]
])

EUROPEPMC = T.StructType([
    T.StructField("resultList", T.StructType([
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField(n, T.StringType())
            for n in ["source", "id", "pmid", "doi", "title", "abstractText", "pubYear",
                      "pubType", "journalTitle", "isOpenAccess", "inPMC"]
        ]))),
    ])),
])

_OUTCOMES = T.ArrayType(T.StructType([
    T.StructField("measure", T.StringType()),
    T.StructField("timeFrame", T.StringType()),
]))
STUDY = T.StructType([
    T.StructField("protocolSection", T.StructType([
        T.StructField("identificationModule", T.StructType([
            T.StructField("nctId", T.StringType()),
            T.StructField("officialTitle", T.StringType()),
            T.StructField("briefTitle", T.StringType()),
        ])),
        T.StructField("descriptionModule", T.StructType([
            T.StructField("briefSummary", T.StringType()),
            T.StructField("detailedDescription", T.StringType()),
        ])),
        T.StructField("statusModule", T.StructType([
            T.StructField("overallStatus", T.StringType()),
            T.StructField("startDateStruct", T.StructType([T.StructField("date", T.StringType())])),
        ])),
        T.StructField("conditionsModule", T.StructType([T.StructField("conditions", TAGS)])),
        T.StructField("armsInterventionsModule", T.StructType([
            T.StructField("interventions", T.ArrayType(
                T.StructType([T.StructField("name", T.StringType())]))),
        ])),
        T.StructField("outcomesModule", T.StructType([
            T.StructField("primaryOutcomes", _OUTCOMES),
            T.StructField("secondaryOutcomes", _OUTCOMES),
        ])),
        T.StructField("designModule", T.StructType([
            T.StructField("phases", TAGS),
            T.StructField("enrollmentInfo", T.StructType([T.StructField("count", T.LongType())])),
        ])),
    ])),
])
STUDIES = T.StructType([T.StructField("studies", T.ArrayType(STUDY))])
