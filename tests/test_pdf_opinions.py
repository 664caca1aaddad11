"""Opinions that exist only as PDF, from replayed pages and a stand-in for the optional package pypdf."""

import sys
import types

import pytest

from lexloom.sources import rest

PAGES = {
    "http://x/clusters/1/": {"sub_opinions": ["http://x/o/1"], "download_url": "http://court/c1.pdf"},
    "http://x/o/1": {"plain_text": "", "html": None, "download_url": "http://court/o1.pdf"},
    "http://court/o1.pdf": b"one|two",
    "http://x/clusters/2/": {"sub_opinions": [{"id": 2}], "download_url": "http://court/c2.pdf"},
    "http://x/opinions/2/": {"download_url": "http://court/gone.pdf"},
    "http://court/c2.pdf": b"of the cluster",
    "http://x/clusters/3/": {"download_url": "http://court/c2.pdf"},
    "http://x/clusters/4/": {"download_url": "http://court/gone.pdf"},
    "http://x/search/": {"results": [{"cluster_id": n, "docketNumber": "7"} for n in (1, 2, 3, 4)], "next": None},
}


def replay(options):
    return lambda url, params: (200, {}, PAGES[url]) if url in PAGES else (404, {}, None)


class Reader:
    def __init__(self, file):
        self.pages = [types.SimpleNamespace(extract_text=lambda t=t: t) for t in file.read().decode().split("|")]


def test_pdf_only_opinions(monkeypatch):
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    client = rest.Client(replay({}))
    got = [rest.cluster_text(client, "http://x", str(n)) for n in (1, 2, 3, 4)]
    assert got == ["one\n\f\ntwo", "of the cluster", "of the cluster", ""]
    options = {"base": "http://x", "circuits": "3rd", "transport": f"{__name__}:replay"}
    reader = rest._Reader(options)
    assert [(r[1], r[5]) for p in reader.partitions() for r in reader.read(p)] == [("1", got[0]), ("2", got[1]), ("3", got[2])]


def test_an_unreachable_file_is_not_skipped(monkeypatch):
    client = rest.Client(lambda url, params: (200, {}, PAGES[url]) if url.endswith("/") else (503, {}, None), lambda s: None, attempts=2)
    with pytest.raises(RuntimeError, match="gave up"):
        rest.cluster_text(client, "http://x", "3")


def test_the_token_stays_with_its_host(monkeypatch):
    seen = []

    class Answer:
        status = 200

        def __init__(self, kind, body):
            import email.message

            self.headers, self.body = email.message.Message(), body
            self.headers["Content-Type"] = kind

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def read(self):
            return self.body

    def urlopen(request, timeout):
        seen.append(request.get_header("Authorization"))
        return Answer("application/json; charset=utf-8", b"{}") if "//x/" in request.full_url else Answer("application/pdf", b"%PDF")

    monkeypatch.setattr(rest.urllib.request, "urlopen", urlopen)
    get = rest.urllib_transport({"base": "http://x/api", "token": "t"})
    assert get("http://x/api/a", None)[2] == {} and get("http://court/a.pdf", None)[2] == b"%PDF"
    assert seen == ["Token t", None]
