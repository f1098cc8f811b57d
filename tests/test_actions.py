import io
import os
import threading
import time

import pytest

from arborquery.cli import main
from arborquery.engine import Engine, Settings, SettingsError, rectify
from arborquery.plans.parser import parse
from arborquery.streaming.auto_update import AutoUpdate

from .tree import make_tree, write


@pytest.fixture
def engine(spark, tmp_path):
    root = str(tmp_path / "root")
    make_tree(root, 4)
    out = Engine(spark, Settings(str(tmp_path / "db"), root))
    out.update(with_postings=False)
    return out


def test_printing(engine, tmp_path):
    out = io.StringIO()
    assert engine.run("-name file0", out=out) == 8
    assert out.getvalue().count("\n") == 8
    target = tmp_path / "list"
    engine.run(f"-fprint0 {target}")
    assert target.read_text().count("\0") == 31
    out = io.StringIO()
    engine.run("-print -a -type l -o -print0", out=out)
    assert (out.getvalue().count("\n"), out.getvalue().count("\0")) == (31, 30)
    out = io.StringIO()
    engine.run("-name file0 -a -print -a -quit 3", out=out)
    assert out.getvalue().count("\n") == 3
    seen = []
    assert engine.run("-type l", callback=lambda r: seen.append(r.basename)) == 1 and seen == ["randomSymlink"]


def test_commands(engine, tmp_path):
    log = tmp_path / "log"
    shell = f"sh -c 'echo \"$0\" >> {log}' {{}} ;"
    assert engine.run(f"-name file0 -a -exec {shell}") == 8
    assert len(log.read_text().split()) == 8
    assert engine.run("-name file0 -a -exec test -s {} ;") == 0
    assert engine.run("-name file1 -a ! -exec false ;") == 4
    log.unlink()
    engine.run(f"-type f -a -exec sh -c 'echo $# >> {log}' x {{}} +")
    assert log.read_text().split() == ["15"]
    log.unlink()
    engine.run(f"-name file0 -a -exec sh -c 'echo $# $2 >> {log}' x to={{}} {{}} +")
    assert log.read_text().split()[0] == "16" and log.read_text().split()[1].startswith("to=/")
    log.unlink()
    engine.run(f"-name randomSymlink -a -execdir sh -c 'pwd >> {log}' ;")
    assert log.read_text().strip().endswith("dir3")
    asked = []
    engine.run(f"-name file0 -a -ok {shell}", confirm=lambda c: asked.append(c) or len(asked) == 1)
    assert len(asked) == 8 and len(log.read_text().split()) == 2
    assert engine.run("-name file0 -a -exec no-such-command-here ;") == 0


def test_deleting(engine):
    out = io.StringIO()
    engine.run("-bregex .*[01] -a -delete --dryrun", out=out)
    assert out.getvalue().count("\n") == 24
    assert engine.run("-bregex .*[01] -a -delete") == 24
    engine.update(with_postings=False)
    assert engine.search("").count() == 7


def test_results_beyond_the_drivers_share_are_written(engine, monkeypatch):
    from arborquery import engine as module

    monkeypatch.setattr(module, "RESULTS", 3)
    assert engine.run("-type f -a -exec test -e {} ;") == 15
    assert engine.run("-type f -a -exec false ; -a -name file0") == 0
    assert engine.run("-name file0 -a -exec true ; -o -name file1") == 12


def test_paths_with_quotes_come_back(tmp_path):
    path = tmp_path / "conf"
    settings = Settings("/a`b/db", "/it's \"x\" `y` \\z").add("ignored", "/p'q")
    settings.save(str(path))
    assert Settings.load(str(path)) == settings


def test_settings(tmp_path):
    path = tmp_path / "conf"
    settings = Settings("/a b/db", "/root").add("ignored", "/x/ y/").add("slow", "z").add("starts", "/s")
    settings.save(str(path))
    again = Settings.load(str(path))
    assert (again.db_path, again.root_path, again.ignored, again.slow) == ("/a b/db", "/root", ["/x/ y"], ["/z"])
    for text in ("ROOT_PATH /", "", "DB_PATH", "DB_PATH `x"):
        path.write_text(text)
        with pytest.raises(ValueError):
            Settings.load(str(path))
    path.write_text("DB_PATH x WHAT IS THIS IGNORED_PATH /y")
    assert Settings.load(str(path)).ignored == ["/y"]
    with pytest.raises(KeyError):
        settings.add("db_path", "/")
    assert issubclass(SettingsError, ValueError) and rectify("a/b//") == "/a/b" and rectify("//") == "/"


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    root = str(tmp_path / "root")
    make_tree(root, 4)
    conf = str(tmp_path / "conf")
    Settings(str(tmp_path / "db"), root).save(conf)
    out = io.StringIO()
    assert main(["-conf", conf, "-true"], spark, out) == 4
    assert main(["-conf", conf, "-updatedb"], spark, out) == 0 and not out.getvalue()
    assert main([root, "-conf", conf, "-name", "file0"], spark, out) == 0 and out.getvalue().count("\n") == 8
    monkeypatch.chdir(f"{root}/dir3")
    out = io.StringIO()
    assert main(["-conf", conf], spark, out) == 0 and out.getvalue().count("\n") == 15
    assert main(["-conf", conf, "-nonsense"], spark, out) == 1 and main(["-conf", f"{conf}x"], spark, out) == 1 and main(["-conf"], spark, out) == 1
    Settings(str(tmp_path / "db"), str(tmp_path / "none")).save(conf)
    assert main(["-conf", conf, "-updatedb"], spark, out) == 3


def test_auto_update(engine):
    root = engine.settings.root_path
    with AutoUpdate(engine, 1) as auto:
        deadline = time.time() + 60
        while auto.updates < 1 and time.time() < deadline:
            time.sleep(0.2)
        write(os.path.join(root, "new"), "")
        seen = auto.updates
        while auto.updates < seen + 2 and time.time() < deadline:
            time.sleep(0.2)
    assert engine.search("-name new").count() == 1
    assert engine.run(parse("-name new"), callback=lambda r: None, tag="some-search") == 1
    threading.Thread(target=engine.cancel, args=("some-search",)).start()
