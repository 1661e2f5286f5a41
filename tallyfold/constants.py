"""Fixed values shared by all operators."""

from pyspark.sql import types as T

RELEVANT = 1
NON_RELEVANT = 0

# Probability floor of the probit link (and variance floor of the acquisition scores).
JITTER = 1e-6

# Fixed annotation schema: positional columns of the annotation CSV.
ANNOTATION_SCHEMA = T.StructType(
    [
        T.StructField("topic_id", T.StringType()),
        T.StructField("worker_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("gold", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
    ]
)

# The published order of the judged topics of the two crowd
# collections; cross-validation folds are consecutive blocks of these lists.
TOPICS_2010 = (
    "20002 20012 20014 20016 20018 20022 20028 20030 20034 20040 "
    "20046 20004 20006 20008 20010 20024 20026 20032 20036 20038 "
    "20042 20044 20048 20050 20064 20076 20102 20112 20144 20152 "
    "20160 20170 20176 20180 20186 20196 20202 20206 20214 20224 "
    "20228 20232 20244 20254 20270 20290 20296 20298 20300 20308 "
    "20330 20332 20340 20352 20374 20384 20398 20412 20416 20420 "
    "20424 20440 20446 20480 20484 20488 20508 20528 20530 20542 "
    "20584 20598 20636 20642 20644 20686 20690 20694 20696 20704 "
    "20714 20764 20766 20778 20956 20962 20986 20996 20780 20812 "
    "20814 20832 20910 20916 20922 20932 20958 20972 20976 20984"
).split()
TOPICS_2011 = (
    "20002 20004 20006 20008 20010 20012 20014 20016 20018 20022 "
    "20024 20026 20028 20030 20032 20034 20036 20038 20040 20042 "
    "20044 20046 20048 20050 20064"
).split()
