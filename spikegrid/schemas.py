"""Fixed schemas of the base tables."""

ANIMALS = "animal_id string, species string, sex string, age double, weight double, genotype string, notes string"
SESSIONS = (
    "animal_id string, tetrode int, session_id string, session_no int, started_at timestamp_ntz, duration double, "
    "sample_rate double, waveform_sample_rate double, arena_height double, arena_width double, ppm double, "
    "stim string, depth string, name string, rec_date date, cylinder boolean, signature string"
)
DEVICES = "session_id string, device string, properties map<string,string>"
TRACKING = "session_id string, i long, t double, x double, y double"
SPIKES = "session_id string, tetrode int, spike_idx long, t double, label int"
WAVEFORMS = "session_id string, tetrode int, spike_idx long, channels int, samples array<float>"
LFP = "session_id string, channel int, i long, v double"
MAPS = "session_id string, cell_id int, kind string, r int, c int, v double"
FIELDS = "session_id string, cell_id int, field_id int, r int, c int, rate double"
SCORES = "session_id string, cell_id int, score string, value double"
NULLS = "session_id string, cell_id int, score string, iter int, value double"
PAIRS = "animal_id string, ses_a int, ses_b int, cell_a string, cell_b string, metric string, value double"
