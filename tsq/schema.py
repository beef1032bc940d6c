"""The engine's data model: dynamically typed values, tags and samples.

A value is a struct (MV) with a kind and one branch per kind. A null struct is an absent value, kind 0 an empty one; the two differ.
"""

#: The kinds of a value, in sorting order.
EMPTY, BOOL, NEGATIVE, UNSIGNED, DOUBLE, STRING, HISTOGRAM = range(7)

HISTOGRAM_DDL = "array<struct<lo:double,hi:double,cnt:double>>"
MV_DDL = f"struct<kind:tinyint,b:boolean,i:bigint,u:decimal(20,0),d:double,s:string,h:{HISTOGRAM_DDL}>"
TAGS_DDL = f"array<struct<k:string,v:{MV_DDL}>>"
SAMPLES_DDL = f"tp_ms bigint, grp array<string>, tags {TAGS_DDL}, metric array<string>, value {MV_DDL}"
