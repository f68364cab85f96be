import io
import json
import threading
import urllib.error
import urllib.request

from stratalog.engine import Engine
from stratalog.server import serve
from stratalog.session import new_path
from stratalog.shell import run


def test_shell_prints_every_row(spark):
    out = io.StringIO()
    run(Engine(spark, new_path(spark, "engine")), io.StringIO("SELECT id, if(id = 1500, 'the widest', NULL) AS v FROM range(2500);\n"), out)
    lines = out.getvalue().splitlines()
    assert "2500 row(s)" in lines[-1] and len(lines) == 2500 + 5
    assert {int(x.split("|")[1]) for x in lines[3:-2]} == set(range(2500))
    assert len({len(x) for x in lines[:-1]}) == 1


def test_server_sends_every_row(spark):
    server = serve(Engine(spark, new_path(spark, "engine")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(text):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}/api/query", data=json.dumps({"sql": text}).encode())
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        for n in (0, 12_000):
            status, body = call(f"SELECT id FROM (SELECT explode(sequence(1, 12000)) AS id) WHERE id <= {n}")
            data = body["data"]
            assert (status, body["success"], body["error"], data["columns"], data["rowCount"], data["truncated"]) == (200, True, None, ["id"], n, False)
            assert sorted(r[0] for r in data["rows"]) == list(range(1, n + 1))
        # an error in a late row is an error, not half an answer
        assert call("SELECT assert_true(id < 11000) FROM (SELECT explode(sequence(1, 12000)) AS id)")[0] == 500
    finally:
        server.shutdown()
