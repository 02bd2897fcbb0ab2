"""DataFrame operators: ranking, folds, features, scoring, blending, neighbours, learners, stacking."""
