"""Ranged reads against a small server that counts requests; messages; log levels."""

import http.server
import threading

import numpy as np
import pytest

import tessera
from tessera.functions import log
from tessera.operators.array import dumps, loads
from tessera.sources.ranged import open_ranged

VALUES = (3 * np.arange(40_000, dtype=np.int64) + 1).reshape(200, 200)


@pytest.fixture
def server():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.headers["Range"])
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            data = VALUES.tobytes()[a : b + 1]
            self.send_response(206)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/x", asked
    s.shutdown()


def test_requests(spark, server):
    url, asked = server
    got = open_ranged(spark, url, (200, 200), "int64", [(10, 20)], block_bytes=4096)
    assert (got.to_numpy() == VALUES[10:20]).all() and len(asked) == 1
    asked.clear()
    got = open_ranged(spark, url, (200, 200), "int64", [(0, 200, 50), (3, 9, 2)], block_bytes=1024)
    assert (got.to_numpy() == VALUES[::50, 3:9:2]).all() and len(asked) == 4
    asked.clear()
    assert (open_ranged(spark, url, (200, 200), "int64").to_numpy() == VALUES).all() and len(asked) == 1


@pytest.mark.parametrize("name", ["uint8", "uint32", "uint64", "float32"])
def test_files(spark, tmp_path, name):
    values = np.arange(1000).astype(name)
    (tmp_path / "x").write_bytes(values.tobytes())
    assert (open_ranged(spark, f"file://{tmp_path}/x", 1000, name, [(100, 900, 3)], 512).to_numpy() == values[100:900:3]).all()
    with pytest.raises(Exception, match="ends before"):
        open_ranged(spark, f"file://{tmp_path}/x", 2000, name).to_numpy()


def test_messages(spark):
    for values in (np.arange(6, dtype=np.uint16).reshape(2, 3), np.array(["é", "", "x,y"]), np.array(2.5), np.zeros((0, 4))):
        array = tessera.from_numpy(spark, values)
        back = loads(spark, dumps(array))
        assert back.dtype == array.dtype and back.shape == array.shape and back.to_numpy().tolist() == array.to_numpy().tolist()
    with pytest.raises(ValueError):
        loads(spark, dumps(tessera.arange(spark, 5))[:-1])
    with pytest.raises(MemoryError):
        dumps(tessera.zeros(spark, 100), most=10)


def test_log_levels():
    for level in ("debug", "ERROR", 0, 4):
        log.set_log_level(level)
    for bad in ("loud", 5, -1, True, None):
        with pytest.raises(ValueError):
            log.set_log_level(bad)
