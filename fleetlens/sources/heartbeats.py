"""Heartbeat and registration messages as batch or streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: fields of the messages as they are on the wire
MOUNT = "struct<available:string,mountpoint:string,device:string,used:string,percent:string,size:string,type:string>"
REPORT = ("struct<role:string,actionId:string,stdout:string,stderr:string,structuredOut:string,status:string,"
          "exitCode:int,clusterName:string,serviceName:string,taskId:bigint,roleCommand:string,"
          "configurationTags:map<string,map<string,string>>>")
COMPONENT = ("struct<componentName:string,msg:string,status:string,serviceName:string,clusterName:string,"
             "stackVersion:string,configurationTags:map<string,map<string,string>>>")
ENVIRONMENT = ("struct<stackFoldersAndFiles:array<struct<name:string,type:string>>,"
               "alternatives:array<struct<name:string,target:string>>,"
               "existingUsers:array<struct<name:string,homeDir:string,status:string>>,existingRepos:array<string>,"
               "installedPackages:array<struct<name:string,version:string,repoName:string>>,"
               "hostHealth:struct<activeJavaProcs:array<struct<user:string,pid:int,hadoop:boolean,command:string>>,"
               "agentTimeStampAtReporting:bigint,serverTimeStampAtReporting:bigint,"
               "liveServices:array<struct<name:string,status:string,desc:string>>>,"
               "umask:int,iptablesIsRunning:boolean>")
PROFILE = ("struct<architecture:string,domain:string,fqdn:string,hardwareisa:string,hardwaremodel:string,"
           "hostname:string,id:string,interfaces:string,ipaddress:string,kernel:string,kernelmajversion:string,"
           "kernelrelease:string,kernelversion:string,macaddress:string,memoryfree:bigint,memorysize:bigint,"
           f"mounts:array<{MOUNT}>,memorytotal:bigint,netmask:string,operatingsystem:string,"
           "operatingsystemrelease:string,osfamily:string,physicalprocessorcount:int,processorcount:int,"
           "selinux:boolean,swapfree:string,swapsize:string,timezone:string,uptime:string,uptime_days:bigint,"
           "uptime_hours:bigint>")
HEARTBEAT_SCHEMA = (f"responseId bigint, timestamp bigint, hostname string, reports array<{REPORT}>, "
                    f"componentStatus array<{COMPONENT}>, mounts array<{MOUNT}>, "
                    f"nodeStatus struct<status:string,cause:string>, agentEnv {ENVIRONMENT}")
REGISTRATION_SCHEMA = ("responseId int, timestamp bigint, hostname string, currentPingPort int, "
                       f"hardwareProfile {PROFILE}, publicHostname string, agentEnv {ENVIRONMENT}, agentVersion string")


def parse_messages(lines: DataFrame, schema: str = HEARTBEAT_SCHEMA) -> DataFrame:
    """One row per text row ``value``; a line that is no JSON message is in ``_broken``, all else null."""
    message = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return lines.filter(F.trim("value") != "").select(message.alias("m")).select("m.*")


def _read(spark: SparkSession, path: str, schema: str, streaming: bool) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return parse_messages(reader.text(path), schema)


def read_heartbeats(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return _read(spark, path, HEARTBEAT_SCHEMA, streaming)


def read_registrations(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return _read(spark, path, REGISTRATION_SCHEMA, streaming)


def flatten_heartbeats(messages: DataFrame, field: str) -> DataFrame:
    """One row per element of ``reports``, ``componentStatus`` or ``mounts``.

    A message with no elements keeps one row with nulls. ``position`` is the place of
    the element in its message. Broken lines give no row, see ``rejected_messages``.
    """
    if "_broken" in messages.columns:
        messages = messages.filter(F.col("_broken").isNull())
    label = F.col("hostname").alias("label")
    return messages.select(label, F.col("responseId").alias("response_id"), "timestamp",
                           F.posexplode_outer(field).alias("position", "_e")).select(
        "label", "response_id", "timestamp", "position", "_e.*")


def rejected_messages(messages: DataFrame) -> DataFrame:
    """The lines that are no messages, as they came."""
    return messages.filter(F.col("_broken").isNotNull()).select(F.col("_broken").alias("line"))
