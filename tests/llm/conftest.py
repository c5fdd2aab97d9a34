import pytest


@pytest.fixture(autouse=True, scope="session")
def shared_dir(spark, tmp_path_factory):
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
