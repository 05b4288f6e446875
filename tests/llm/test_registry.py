from tests.engine.test_entry import imported


def test_a_missing_dependency_is_an_error():
    done = imported("ahocorasick")
    assert done.returncode != 0 and "ahocorasick" in done.stderr
    assert imported().stdout.split()[1] == "True"
