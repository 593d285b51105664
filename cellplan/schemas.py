"""Column types of the package's tables. A label or voxel that is absent is background."""

VOXELS = "image_id string, channel int, z int, y int, x int, intensity double"
LABELS = "image_id string, layer string, z int, y int, x int, label int"
IMAGES = "image_id string, mode string, nz int, ny int, nx int, width_um double, height_um double, depth_um double, sz double, sy double, sx double"
METADATA = "Filename string, `Width (um)` double, `Height (um)` double, `Depth (um)` double, Slices int"
DISTANCES = "label_a int, label_b int, distance_um float"
CHECKPOINTS = "image_id string, mode string, step int, artifact string, path string, present boolean"
STEP_CONFIG = "step string, parameter string, type string, value string, min double, max double, step_size double"
