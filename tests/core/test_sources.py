import zipfile
from datetime import datetime

import pytest

from flowlens.sources import extract_zip, find_file, find_tabular, load_dataset, read_lines, require_files, resolve_adapter


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_bank_transfers(spark, tmp_path):
    for head in ("Timestamp,From Bank,Account,To Bank,Account.1,Amount Received,Payment Format,Is Laundering", "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Payment Format,Is Laundering"):
        put(tmp_path, "HI-Small_Trans.csv", f"{head}\n2022/09/01 00:20,10,8000EBD30,20,8000F5340,3697.34,Wire,0\n2022/09/01 00:21,10,,20,8000F5341,1.0,Cash,1\n")
        r = load_dataset(spark, "ibm", tmp_path).transactions().collect()
        assert len(r) == 1 and (r[0].source, r[0].target, r[0].amount, r[0].label) == ("8000EBD30", "8000F5340", 3697.34, 0)
        assert r[0].timestamp == datetime(2022, 9, 1, 0, 20) and r[0]["Timestamp__raw"] == "2022/09/01 00:20" if "Timestamp__raw" in r[0].asDict() else True
    put(tmp_path, "HI-Small_accounts.csv", "Bank Name,Account Number\nx,1\n")
    put(tmp_path, "HI-Small_Patterns.txt", "BEGIN, \"FAN\tmore\nline two\n")
    d = load_dataset(spark, "IBM_AML", tmp_path, variant="hi-small")
    assert d.accounts().count() == 1 and [x.pattern for x in d.patterns().collect()] == ['BEGIN, "FAN', "line two"]
    with pytest.raises(ValueError):
        load_dataset(spark, "ibm", tmp_path, variant="huge").transactions()


def test_stepped_sets(spark, tmp_path):
    put(tmp_path / "a", "PS_log.csv", "step,type,amount,nameOrig,nameDest,isFraud\n1,X,5.0,C1,M1,0\n2,X,6.0,C2,M2,1\n")
    got = load_dataset(spark, "paysim", tmp_path / "a").transactions().orderBy("step").collect()
    assert [(r.timestamp, r.label) for r in got] == [(datetime(1970, 1, 1, 1), 0), (datetime(1970, 1, 1, 2), 1)]
    put(tmp_path / "b", "bs140513_032310.csv", "step,customer,merchant,amount,fraud\n3,'C1','M1',5.0,1\n")
    r = load_dataset(spark, "banksim", tmp_path / "b").transactions().first()
    assert (r.source, r.target, r.timestamp, r.label) == ("C1", "M1", datetime(1970, 1, 4), 1)


def test_found_by_names(spark, tmp_path):
    put(tmp_path / "c", "SAML-D_transactions.csv", "Date,Time,Sender_account,Receiver_account,Amount,Is_laundering\n2022-10-07,10:35:19,1,2,3.5,0\n")
    r = load_dataset(spark, "saml-d", tmp_path / "c").transactions().first()
    assert (r.source, r.target, r.label) == ("1", "2", 0)


def test_ledger_graphs(spark, tmp_path):
    put(tmp_path, "elliptic_txs_features.csv", "11,1,0.5\n12,2,0.7\n")
    put(tmp_path, "elliptic_txs_classes.csv", "txId,class\n11,1\n12,unknown\n")
    put(tmp_path, "elliptic_txs_edgelist.csv", "txId1,txId2\n11,12\n")
    g = load_dataset(spark, "elliptic", tmp_path).graph()
    assert {r.transaction_id: r.label for r in g.nodes.collect()} == {"11": 1, "12": None} and g.edges.first().edge_relation == "precomputed"
    with pytest.raises(NotImplementedError):
        load_dataset(spark, "elliptic", tmp_path).transactions()
    put(tmp_path / "p", "txs_features.csv", "txId,Time step\n1,1\n2,1\n")
    put(tmp_path / "p", "txs_classes.csv", "txId,class\n1,2\n2,1\n")
    put(tmp_path / "p", "txs_edgelist.csv", "txId1,txId2\n1,2\n")
    assert {r.label for r in load_dataset(spark, "elliptic++", tmp_path / "p").nodes().collect()} == {0, 1}


def test_files(spark, tmp_path):
    put(tmp_path, "x/deep/a.csv", "a\n")
    put(tmp_path, "__MACOSX/b_log.csv", "a\n")
    put(tmp_path, "y/._c_log.csv", "a\n")
    put(tmp_path, "z/the_log.csv", "a\n")
    assert find_file(tmp_path, "a.csv").endswith("x/deep/a.csv") and find_tabular(tmp_path, ("log",)).endswith("z/the_log.csv") and find_tabular(f"file://{tmp_path}").endswith("x/deep/a.csv")
    with pytest.raises(FileNotFoundError):
        require_files(tmp_path, ["a.csv", "none.csv"])
    with pytest.raises(FileNotFoundError):
        find_tabular(put(tmp_path, "empty/readme.txt", "").parent)
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../outside.csv", "a")
    with pytest.raises(ValueError):
        extract_zip(tmp_path / "bad.zip", tmp_path / "out")
    assert not (tmp_path / "outside.csv").exists()
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("in/t.csv", "a\n1\n")
    assert [p.rpartition("/")[2] for p in extract_zip(tmp_path / "good.zip", tmp_path / "out")] == ["t.csv"]
    assert read_lines(spark, str(tmp_path / "out/in/t.csv")).count() == 2


def test_registry(spark, tmp_path):
    with pytest.raises(ValueError):
        resolve_adapter("unknown")
    with pytest.raises(ValueError):
        load_dataset(spark, "paysim", tmp_path, variant="hi-small")
