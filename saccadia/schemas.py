"""Declared schemas and the fixed values of the recording protocol."""

from __future__ import annotations

# Colours as the recorder writes them.
RED = "255 0 0"
GREEN = "0 255 0"
BLUE = "0 0 255"
WHITE = "255 255 255"
COLOUR_NAMES = {RED: "red", GREEN: "green", BLUE: "blue", WHITE: "white"}

# Experiments and the prefix of their recording files.
EXPERIMENT_PREFIXES = {
    "ANTI_SACCADE": "anti-saccade",
    "FITTS_LAW": "FittsLaw",
    "FIXATIONS": "Fixations",
    "KING_DEVICK": "KingDevick",
    "EVIL_BASTARD": "Patterns",
    "REACTION": "Reaction",
    "SHAPES": "Shapes",
    "SMOOTH_PURSUITS": "SmoothPursuits",
}
EXPERIMENTS = list(EXPERIMENT_PREFIXES)

# Participants left out of every analysis.
EXCLUDED_PARTICIPANTS = [87, 89, 93, 96, 103, 105, 109, 117, 118, 119, 120, 127, 128, 141]

# Screen size in pixels, its centre and the tolerance around it, sampling rate in Hz.
SCREEN_WIDTH, SCREEN_HEIGHT = 1920, 1080
CENTRE_X, CENTRE_Y = 960, 540
CENTRE_TOLERANCE = 50
SAMPLE_RATE = 2000

TRIAL = ["participant_id", "trial_id"]


def trial_of(df) -> list[str]:
    """Key of a trial: trial ids are counted anew in every experiment, so a frame that names the experiment needs it too."""
    return ["experiment", *TRIAL] if "experiment" in df.columns else list(TRIAL)


# Columns of events and samples with their types.
EVENT_TYPES = {
    "experiment": "string", "participant_id": "bigint", "trial_id": "bigint", "time": "bigint",
    "event": "string", "eye": "string", "colour": "string",
    "stimulus_x": "double", "stimulus_y": "double",
    "start_time": "double", "end_time": "double", "duration": "double",
    "x": "double", "y": "double", "avg_pupil_size": "double",
    "start_x": "double", "start_y": "double", "end_x": "double", "end_y": "double",
    "amplitude": "double", "peak_velocity": "double",
    "side": "string", "time_elapsed": "double", "delay": "double", "angle": "double", "speed": "double",
    "target_x": "double", "target_y": "double", "pos_x": "double", "pos_y": "double",
    "distance": "double", "target_width": "double", "target_shape": "string",
    "marks": "bigint", "shape": "string",
}

# Columns that a recording announces itself with its TRIAL_VAR_LABELS line.
TRIAL_VARIABLES = ["side", "time_elapsed", "delay", "angle", "speed", "target_x", "target_y", "pos_x", "pos_y",
                   "distance", "target_width", "target_shape", "marks", "shape"]

SAMPLE_TYPES = {
    "experiment": "string", "participant_id": "bigint", "trial_id": "bigint", "time": "bigint",
    "x_left": "double", "y_left": "double", "pupil_size_left": "double",
    "x_velocity_left": "double", "y_velocity_left": "double",
    "x_right": "double", "y_right": "double", "pupil_size_right": "double",
    "x_velocity_right": "double", "y_velocity_right": "double",
    "x_resolution": "double", "y_resolution": "double", "error_message": "string",
}

# Column order of a sample line by tracked eyes; "." is a filler column.
SAMPLE_LAYOUTS = {
    "LR": ["time", "x_left", "y_left", "pupil_size_left", "x_right", "y_right", "pupil_size_right",
           "x_velocity_left", "y_velocity_left", "x_velocity_right", "y_velocity_right",
           "x_resolution", "y_resolution", ".", "error_message"],
    "L": ["time", "x_left", "y_left", "pupil_size_left", "x_velocity_left", "y_velocity_left",
          "x_resolution", "y_resolution", ".", "error_message"],
    "R": ["time", "x_right", "y_right", "pupil_size_right", "x_velocity_right", "y_velocity_right",
          "x_resolution", "y_resolution", ".", "error_message"],
}

