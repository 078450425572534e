import subdrift as sd
from subdrift.streaming import grade_new_files, samples_from_files
from tests.conftest import SMALL
from tests.helpers import contents
from workload import inputs


def test_two_runs_grade_each_sample_once(spark, scratch):
    samples = inputs.samples(spark, SMALL, fleet=True)
    parms = inputs.fleet_parms_apply(spark, SMALL)
    samples.where("sample_id < 400").write.parquet(f"{scratch}/in")

    def run():
        stream = samples_from_files(spark, f"{scratch}/in", samples.schema)
        grade_new_files(
            stream, lambda s: sd.end_to_end_latency_cause(s, parms), f"{scratch}/out", f"{scratch}/checkpoint"
        )
        return spark.read.parquet(f"{scratch}/out")

    batch = sd.end_to_end_latency_cause(samples, parms)
    assert contents(run()) == contents(batch.where("sample_id < 400"))
    samples.where("sample_id >= 400").write.mode("append").parquet(f"{scratch}/in")
    assert contents(run()) == contents(batch)
    assert contents(run()) == contents(batch)


def test_shuffled_parameters_work_on_a_stream_too(spark, scratch):
    samples = inputs.samples(spark, SMALL, fleet=True)
    parms = inputs.fleet_parms_capture(spark, SMALL)
    samples.write.parquet(f"{scratch}/in")
    grade_new_files(
        samples_from_files(spark, f"{scratch}/in", samples.schema),
        lambda s: sd.capture_latency(s, parms, hot=sd.hot_scopes(samples, 5), strategy="merge"),
        f"{scratch}/out",
        f"{scratch}/checkpoint",
    )
    assert contents(spark.read.parquet(f"{scratch}/out")) == contents(sd.capture_latency(samples, parms))
