"""Schemas of the tables that the operators read."""

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DecimalType, DoubleType, LongType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


LABEL = _struct(k=StringType(), v=StringType())
LOG_ENTRY = _struct(term=LongType(), idx=LongType(), command=BinaryType(), type=ByteType())
CONFIGURATION = _struct(nodes=ArrayType(LongType()), is_joint_consensus=BooleanType(), old_nodes=ArrayType(LongType()), learners=ArrayType(LongType()))
SNAPSHOT = _struct(last_included_index=LongType(), last_included_term=LongType(), configuration=CONFIGURATION, state=BinaryType())
VOTE_REQUEST = _struct(term=LongType(), candidate_id=LongType(), last_log_index=LongType(), last_log_term=LongType())
APPEND_REQUEST = _struct(term=LongType(), leader_id=LongType(), prev_log_index=LongType(), prev_log_term=LongType(), entries=ArrayType(LOG_ENTRY), leader_commit=LongType())
APPEND_RESPONSE = _struct(term=LongType(), success=BooleanType(), conflict_index=LongType(), conflict_term=LongType())
NODE_STATE = _struct(node_id=LongType(), current_term=LongType(), commit_index=LongType(), last_applied=LongType(), is_leader=BooleanType(), log=ArrayType(LOG_ENTRY))
EDGE = _struct(src=StringType(), dst=StringType(), latency_ms=LongType(), reliability=DoubleType())
METRIC = _struct(name=StringType(), dimensions=ArrayType(LABEL), shape=StringType(), value=DoubleType())
LOG_RECORD = _struct(time_unix_nano=LongType(), level=StringType(), message=StringType(), kv=ArrayType(LABEL))
DIGEST = _struct(node_id=LongType(), address=StringType(), term=LongType(), last_log_index=LongType(), fresh_until=LongType())
MANIFEST_OBJECT = _struct(relative_key=StringType(), size_bytes=LongType(), checksum_md5=StringType())
#: Serials may exceed a signed 64-bit integer.
CERTIFICATE = _struct(serial=DecimalType(20, 0), subject=StringType(), dns_names=ArrayType(StringType()), ip_addresses=ArrayType(StringType()), certificate_pem=StringType(), not_before=TimestampType(), not_after=TimestampType(), revoked_at=TimestampType())
