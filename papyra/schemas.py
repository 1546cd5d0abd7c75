"""Fixed schemas (never inferred: a doc-map would infer one column per file name)."""

from pyspark.sql import types as T

PHONE = T.StructType([T.StructField(n, T.StringType()) for n in ("country", "area", "prefix", "line")])

CONTACT_INFO = T.StructType([
    T.StructField("emails", T.ArrayType(T.StringType())),
    T.StructField("phone_numbers", T.ArrayType(PHONE)),
    T.StructField("linkedin", T.ArrayType(T.StringType())),
    T.StructField("github", T.ArrayType(T.StringType())),
    T.StructField("urls", T.ArrayType(T.StringType())),
])

# In the doc-map files phones are lists of four strings (JSON of Python tuples).
CONTACT_INFO_FILE = T.StructType([
    T.StructField("emails", T.ArrayType(T.StringType())),
    T.StructField("phone_numbers", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("linkedin", T.ArrayType(T.StringType())),
    T.StructField("github", T.ArrayType(T.StringType())),
    T.StructField("urls", T.ArrayType(T.StringType())),
])

DOC_RECORD_TYPE = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("is_resume", T.BooleanType()),
    T.StructField("contact_info", CONTACT_INFO),
    T.StructField("created_time", T.StringType()),
    T.StructField("hash_id", T.StringType()),
])

DOC_RECORD_FILE_TYPE = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("is_resume", T.BooleanType()),
    T.StructField("contact_info", CONTACT_INFO_FILE),
    T.StructField("created_time", T.StringType()),
    T.StructField("hash_id", T.StringType()),
])

DOCMAP = T.MapType(T.StringType(), DOC_RECORD_FILE_TYPE)

HASH_LEDGER = T.StructType([
    T.StructField("Filename", T.StringType()),
    T.StructField("Hash ID", T.StringType()),
    T.StructField("Is Resume", T.StringType()),
])

STATUS_LEDGER = T.StructType([
    T.StructField("document_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])

POINT = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), False)),
    T.StructField("payload", T.StructType([
        T.StructField("text_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("document_name", T.StringType()),
    ])),
])

ANALYSIS = T.StructType([
    T.StructField("Overall_Match_Score", T.StringType()),
    T.StructField("Skill_Match_Breakdown", T.StructType([
        T.StructField("Technical_Skills", T.StringType()),
        T.StructField("Soft_Skills", T.StringType()),
        T.StructField("Certifications", T.StringType()),
    ])),
    T.StructField("Experience_Relevance", T.StructType([
        T.StructField("Years_of_Relevant_Experience", T.StringType()),
        T.StructField("Experience_Quality", T.StringType()),
    ])),
    T.StructField("Project_Alignment", T.ArrayType(T.StructType([
        T.StructField("Project_Name", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Relevance_Score", T.DoubleType()),
    ]))),
    T.StructField("Key_Strengths", T.ArrayType(T.StringType())),
    T.StructField("Notable_Gaps", T.ArrayType(T.StringType())),
    T.StructField("Overall_Assessment", T.StringType()),
    T.StructField("Recommendations", T.MapType(T.StringType(), T.StringType())),
])
