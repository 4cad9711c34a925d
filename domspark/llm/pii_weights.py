"""Weights of the features of `pii._NAMES`, in their order, by kind. Made by `python -m domspark.llm.pii`."""

WEIGHTS = {
    "email": [-2.538, 1.248, -0.437, -0.914, -0.758, -0.08, -0.336, -0.499, -0.167, -0.128, -0.466, -0.179, -0.952, -0.014, -0.005, -0.045, -0.129, 0.825, -0.572, -4.148, -0.251, -0.153, 0.069, 0.811, 1.234, 2.647, -1.413, -1.223, -3.595, -3.296, 0.0, 0.0, -0.088, -0.039, -0.021, -0.121, -0.009, -0.014, -0.086, 0.865, -0.137, -1.313, -0.065, 0.298, -1.338, -0.008, -0.53, -0.088, -0.014],
    "ip": [-3.202, -0.224, -0.788, -1.014, -0.472, 0.453, -0.363, -0.424, -0.108, -0.073, -0.189, -0.283, -0.685, -0.017, -0.011, 5.883, -0.937, 0.452, -0.775, -2.042, -0.501, -0.851, -1.305, -0.445, -0.236, -0.026, -0.21, -0.693, -1.936, -1.639, 0.0, 0.0, -0.878, -0.109, -0.165, -0.286, -0.022, -0.015, 0.73, -0.006, -0.727, 0.198, -0.361, -0.418, 0.171, -0.01, -0.569, -0.197, -0.071],
    "card": [-2.43, -0.116, -0.9, -1.45, -0.487, -0.081, -0.641, -0.464, 2.688, -0.227, -0.752, 2.847, -1.491, -0.031, -0.006, -0.017, -0.25, -1.027, -0.288, -1.511, -0.324, -0.867, -3.634, -0.752, -0.143, -0.012, -0.13, 0.264, -1.349, -0.922, 0.0, 0.0, -1.153, -0.046, 2.175, -0.262, -0.015, 0.945, 0.087, -0.004, -0.483, -0.619, -1.159, 0.205, -1.514, -0.025, -0.487, -0.055, -0.015],
    "phone": [-2.546, -0.127, -1.413, -2.089, 0.125, 2.05, -0.088, -0.289, -0.278, -0.092, -0.346, -0.271, -0.475, 2.874, 2.594, -0.17, -1.004, -1.069, 0.108, -1.576, 0.344, -0.871, -3.248, -0.576, -0.162, -0.012, -0.15, -0.751, -2.576, -2.042, 0.0, 0.0, -0.042, 2.866, -0.593, -0.386, 2.094, -0.019, -0.168, -0.004, 1.109, -0.073, -0.18, -0.489, -0.304, 2.957, -0.508, 2.892, 2.404],
}
